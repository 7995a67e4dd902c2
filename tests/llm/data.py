"""Small tables for the text operators: every awkward row at once."""

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp long, words int, key string, score double, host string, line string"
LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog in the yard"),
    (2, "The cat sat on the mat and looked at the dog in the yard"),
    (3, "the cat sat on the mat and looked at the dog in the yard"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "1234 5678 !!! ###"),
    (8, "Der Hund und die Katze sind in dem Haus und der Garten ist schön"),
    (9, LONG),
    (9, LONG),
    (None, "a text that has no id but some words of its own here"),
    (11, "one two"),
    (12, "go go go go go go go go go go go go go go"),
    (13, "😀 emoji \u00a0 and \u2028 rare\x1cspaces <|endoftext|> é ñ"),
]


def docs(spark, texts=TEXTS, **columns):
    values = {"lang": "en", "source": "s", "n_chars": 0, "h": 1, "fp": 2, "words": 3, "key": "k", "score": 4.0, "host": "x", "line": "y"} | columns
    rows = [(i, t, *(values[c] for c in ("lang", "source", "n_chars", "h", "fp", "words", "key", "score", "host", "line"))) for i, t in texts]
    return spark.createDataFrame(rows, DOCS_SCHEMA)


def nulls(spark):
    """Rows that are null in every column, or in all but the text."""
    return spark.createDataFrame([(None,) * 12, (None, "some words without an id or a host at all here", *(None,) * 10)], DOCS_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOCS_SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]

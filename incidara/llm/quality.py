"""Quality rules: statistics of each document, and lines that many documents of a host share.

Everything is a DataFrame expression.  Per document, words, repeated five-word windows and
repeated lines are measured inside the row.  Across documents, each normalised line is hashed and
counted once for each different text of a host, so exact copies count once.  A line is boilerplate where
more than ``max_line_docs`` texts of a host have it and what surrounds it differs in at least half of them,
as the lines of near copies keep their surroundings.  That is judged twice: by the lines next to it; and,
for blocks of several lines, which are one another's neighbours, by the nearest line on each side that is not
itself above the limit, in texts that would not be depleted without all such lines (near copies would be).
Boilerplate is removed; a document is depleted, and rejected, if of its words under ``min_left_percent`` stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidara.llm.support import WHITE, ascii_lower, let, settle, text_or_empty

MAX_LINE_DOCS = 20
MIN_LEFT_PERCENT = 25
#: Rows of a table of lines up to which it is broadcast (under 10 MB); a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
WINDOW = 5
_GAP = "[ \\t-\\r]+"


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP))


def repeated_words(word_list: Column) -> Column:
    """How many words stand in a five-word window that the text has twice or more."""

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    def covered(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def starts(placed: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(placed, i)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(placed, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))

        nothing = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            let(placed, starts),
            nothing,
            lambda seen, at: F.struct((seen["n"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("n"), at.alias("last")),
            lambda seen: seen["n"],
        )

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))

    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(windows(h), count))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The statistics of one text by name."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    counts = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        ),
    )
    return {
        "counts": counts,
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def normal_line(line: Column) -> Column:
    return F.btrim(let(ascii_lower(line), _one_space), F.lit(" "))


def _one_space(text: Column) -> Column:
    """Each run of white space but newlines as one space; most texts have no other and stay as they are."""
    plain = ~F.contains(text, F.lit("  "))
    for c in "\t\x0b\f\r":
        plain = plain & ~F.contains(text, F.lit(c))
    return F.when(plain, text).otherwise(F.regexp_replace(text, "[ \\t\\x0B\\f\\r]+", " "))


def normal_lines(text: Column) -> Column:
    """The lines with a word, A-Z lower-cased and each run of white space made one space."""
    lines = F.transform(F.split(let(ascii_lower(text), _one_space), "\n"), lambda line: F.btrim(line, F.lit(" ")))
    return F.filter(lines, lambda line: line != "")


def line_length(line: Column) -> Column:
    """Words of a normal line."""
    return (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def document_lines(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """One row for each different line of each different text of a host: ``host, text_hash, line`` and

    the place ``at`` and the neighbours' ``context`` where it first stands, its ``words``, and ``times``, how often
    it stands in all the copies of the text together.
    """

    def placed(lines: Column) -> Column:
        def rows(hashes: Column) -> Column:
            beside = lambda i: F.coalesce(F.get(hashes, i), F.lit(0).cast("long"))
            return F.transform(
                lines,
                lambda line, i: F.struct(
                    i.alias("at"),
                    F.get(hashes, i).alias("line"),
                    F.xxhash64(beside(i - 1), beside(i + 1)).alias("context"),
                    line_length(line).alias("words"),
                ),
            )

        return let(F.transform(lines, lambda line: F.xxhash64(line)), rows)

    text = text_or_empty()
    found = docs.select(_host(host_col).alias("host"), F.xxhash64(text).alias("text_hash"), F.inline(let(normal_lines(text), placed)))
    first = F.min_by("context", "at").alias("context")
    return found.groupBy("host", "text_hash", "line").agg(F.min("at").alias("at"), first, F.max("words").alias("words"), F.count(F.lit(1)).alias("times"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` written, and broadcast if it has at most ``BROADCAST_ROWS`` rows; a plain join with it can be split."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def block_boilerplate(lines: DataFrame, min_left_percent: int) -> DataFrame:
    """``host, line`` of the lines above the limit (``texts`` is not null) whose nearest lines below it differ in half of their texts."""
    of_text = Window.partitionBy("host", "text_hash")
    own = F.col("texts").isNull()
    upto = of_text.rowsBetween(Window.unboundedPreceding, 0)
    nearest = lambda order: F.coalesce(F.last(F.when(own, F.col("line")), ignorenulls=True).over(upto.orderBy(order)), F.lit(0).cast("long"))
    size = F.col("words") * F.col("times")
    solid = 100 * F.sum(F.when(own, size).otherwise(0)).over(of_text) >= min_left_percent * F.sum(size).over(of_text)
    edges = lines.withColumns({"before": nearest(F.asc("at")), "after": nearest(F.desc("at")), "solid": solid}).filter(~own & F.col("solid"))
    counted = edges.groupBy("host", "line").agg(F.countDistinct(F.xxhash64("before", "after")).alias("edges"), F.max("texts").alias("texts"))
    return counted.filter(2 * F.col("edges") >= F.col("texts")).select("host", "line")


def shared_lines(docs: DataFrame, host_col: str, max_line_docs: int, min_left_percent: int) -> DataFrame:
    """The texts that have boilerplate: ``host, text_hash``, its ``lines``, their words ``shared`` (each line once), and whether ``depleted``."""
    lines = settle(document_lines(docs, host_col))  # read three times
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("context").alias("contexts"))
    over = _small(counted.filter(F.col("texts") > max_line_docs))
    texts = lines.join(over, ["host", "line"]).select("host", "text_hash").distinct()
    some = settle(lines.join(texts, ["host", "text_hash"], "left_semi").join(over, ["host", "line"], "left").drop("context"))
    alone = over.filter(2 * F.col("contexts") >= F.col("texts")).select("host", "line")
    known = _small(alone.unionByName(block_boilerplate(some, min_left_percent)).distinct().withColumn("known", F.lit(True)))
    marked = some.join(known, ["host", "line"], "left")
    gone = lambda what: F.sum(F.when(F.col("known"), what))
    size = F.col("words") * F.col("times")
    found = marked.groupBy("host", "text_hash").agg(
        gone(F.col("words")).alias("shared"),
        (100 * (F.sum(size) - gone(size)) < min_left_percent * F.sum(size)).alias("depleted"),
        F.collect_set(F.when(F.col("known"), F.col("line"))).alias("lines"),
    )
    return settle(found.filter("shared > 0"))  # written, so that the join of a text with many copies can be split


def judge(
    docs: DataFrame, host_col: str = "source", max_line_docs: int = MAX_LINE_DOCS, min_left_percent: int = MIN_LEFT_PERCENT
) -> DataFrame:
    """Measures and verdict of each row of ``docs``.

    Null text counts as no text (it fails), a null host as a host named ''.  Each repeated row gets the same
    verdict; rows that share an id are judged one by one.  Columns other than id, text and host are ignored.
    """
    text = text_or_empty()
    removed = shared_lines(docs, host_col, max_line_docs, min_left_percent).select("host", "text_hash", "shared", "depleted")
    found = measures(text)
    rows = docs.select(
        "doc_id",
        _host(host_col).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        found["counts"].alias("counts"),
        *[found[name].alias(name) for name in ("n_symbols", "n_dup_lines")],
    )
    n_words, repeats = F.col("counts.n_words"), F.col("counts.n_repeat_words")
    failed = (n_words < 10) | (100 * repeats > 20 * n_words)
    depleted = F.coalesce("depleted", F.lit(False))
    return rows.join(removed, ["host", "text_hash"], "left").select(
        "doc_id", n_words.alias("n_words"), "counts.word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce("shared", F.lit(0).cast("long")).alias("shared_words"),
    )


def clean(docs: DataFrame, host_col: str = "source", max_line_docs: int = MAX_LINE_DOCS, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without their boilerplate lines.

    Repetition is judged on what stays of a text, so a line that a site puts at both ends of its pages
    does not count against them; length on the whole text and on what stays.  A text is depleted if under
    ``min_left_percent`` of its words stay, each line counted as often as it stands there.  All columns
    stay; ``text`` loses the lines and ``n_chars``, if there is one, is counted anew.
    """
    columns = docs.columns
    text = text_or_empty()
    shared = shared_lines(docs, host_col, max_line_docs, min_left_percent).select(
        F.col("host").alias("_incidara_host"), F.col("text_hash").alias("_incidara_text"), F.col("lines").alias("_incidara_lines"), F.col("depleted").alias("_incidara_depleted")
    )
    keyed = docs.withColumns({"_incidara_host": _host(host_col), "_incidara_text": F.xxhash64(text)})
    joined = keyed.join(shared, ["_incidara_host", "_incidara_text"], "left")
    whole = F.col("_incidara_lines").isNull()
    long_enough = joined.filter((F.size(words(text)) >= 10) & (whole | ~F.col("_incidara_depleted")))
    without = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains("_incidara_lines", F.xxhash64(normal_line(line)))), "\n")
    stripped = long_enough.withColumn("text", F.when(whole, F.col("text")).otherwise(without))
    enough = whole | (F.size(words(text_or_empty())) >= 10)
    varied = let(measures(text_or_empty())["counts"], lambda c: 100 * c["n_repeat_words"] <= 20 * c["n_words"])
    stay = stripped.filter(enough & varied)
    if "n_chars" in columns:
        stay = stay.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return stay.select(*columns)

"""Language identification by rank-order profiles.

A profile is a language's most frequent n-grams in order.  A document's own most frequent n-grams
are compared to each profile by out-of-place distance: for each n-gram the difference of its two
ranks, or the profile's length where the language does not have it.  The least distance wins.

N-grams are runs of one to three characters inside words, a word's ends counting as a character;
three code points fit one integer, so numpy counts them without a dictionary.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidara.llm.word_encoder import slices
from incidara.shipping import shipped

#: N-grams in a profile, and of a document that are compared.
PROFILE = 300
#: Different n-grams that a task holds for a language before it passes their counts on.
HELD = 2_000_000
#: Characters of a text whose n-grams are held at once.
AT_ONCE = 1 << 20
UNKNOWN = "und"
#: Nearness to the best profile below which a text is in no known language.  Words of random letters come to
#: 0.14 to 0.26; the furthest of 256,410 texts in learned languages to 0.35 (one word over and over).
MIN_NEARNESS = 0.25
_EDGE = np.int64(0x20)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark on one, 0 for others."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text in lower case, repeats included."""
    points = _points(text)
    letter = _letters()[points] > 0
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character behind a word stands for its end
    points = np.where(letter, points, _EDGE)[keep]
    if points[-1] != _EDGE:
        points = np.append(points, _EDGE)
    points = np.concatenate([[_EDGE], points])
    inner = points != _EDGE
    two = (points[:-1] << 21 | points[1:])[inner[:-1] | inner[1:]]
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inner[1:-1]]
    return np.concatenate([points[inner], two, three])


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and the sums of their counts."""
    found, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)


def _pieces(text: str, at_once: int) -> Iterator[tuple[int, int, bool]]:
    """Bounds of pieces of about ``at_once`` characters, and whether the piece ends inside a word.

    A piece ends before the first character that is no letter, or where none comes for as long as the piece.
    """
    begin = 0
    while begin < len(text):
        end = begin + at_once
        other = np.flatnonzero(_letters()[_points(text[end : end + at_once])] == 0)
        inside = not len(other) and end < len(text)
        end = min(end + int(other[0]), len(text)) if len(other) else end if end + at_once < len(text) else len(text)
        yield begin, end, inside and end < len(text) and bool(_letters()[ord(text[end - 1])])
        begin = end


def _across(text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
    """What a cut inside a word at ``at`` changes: n-grams that it makes (counted -1) and parts (1)."""
    y, z, a, b = (int(p) if letter else int(_EDGE) for p, letter in _around(text, at))
    codes = [z << 21 | _EDGE, y << 42 | z << 21 | _EDGE, _EDGE << 21 | a, _EDGE << 42 | a << 21 | b, z << 21 | a, y << 42 | z << 21 | a, z << 42 | a << 21 | b]
    return np.array(codes, np.int64), np.array([-1, -1, -1, -1, 1, 1, 1], np.int64)


def _around(text: str, at: int) -> Iterator[tuple[int, bool]]:
    """The two characters on each side of ``at``, and whether each is a letter."""
    for k in range(at - 2, at + 2):
        point = ord(text[k]) if 0 <= k < len(text) else 0x20
        yield point, bool(_letters()[point])


def gram_counts(text: str, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of one text and their counts; none if it has no letter.  A long text is counted in pieces."""
    text = text.lower()
    codes, counts, letters = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for begin, end, inside in _pieces(text, max(2, at_once)):
        letters = letters or bool((_letters()[_points(text[begin:end])] == 2).any())
        some, n = np.unique(grams(text[begin:end]), return_counts=True)
        more, m = _across(text, end) if inside else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        codes, counts = _merged([codes, some, more], [counts, n, m]) if len(codes) or inside else (some, n)
    if not letters:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return codes[counts > 0], counts[counts > 0]


def gram_text(code: int) -> str:
    """The n-gram of a code, word ends as spaces."""
    return "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0) if code >> s)


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages that ``docs`` names in ``lang``; rows without text or lang teach nothing.

    Every row is counted, in the tasks and then by one aggregation; only ``size`` codes for each
    language come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            codes, counts = held[lang]
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes), "n": pa.array(counts)})

        for batch in batches:
            for at, n in slices(batch.column("text")):
                names = batch.column("lang").slice(at, n).to_pylist()
                texts = batch.column("text").slice(at, n).to_pylist()
                for lang in dict.fromkeys(names):
                    codes, counts = gram_counts("\n".join(t for t, name in zip(texts, names, strict=True) if name == lang))
                    if lang in held:
                        codes, counts = _merged([held[lang][0], codes], [held[lang][1], counts])
                    held[lang] = codes, counts
                    if len(codes) > HELD:
                        yield rows(lang)
                        del held[lang]
        for lang in held:
            yield rows(lang)

    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = shipped(labelled).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    profiles: dict[str, list[int]] = {}
    for row in best.select("lang", "gram", "place").orderBy("lang", "place").collect():  # bounded: size for each language
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.codes = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)  # the last row: in no profile
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def guess(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text or "")
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, top)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != top] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None]))
        totals = np.minimum(apart, self.size).sum(axis=0)
        best = int(np.argmin(totals))
        return self.names[best], 1.0 - float(totals[best]) / (self.size * len(top))


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``lang_pred`` and ``score`` (0 to 1: nearness to the profile).

    Text that is null or has no letter is ``und`` with score 0, as is everything without profiles.
    Two languages at one distance: the first by name; two n-grams as frequent: the shorter, then by code points.
    Each repeated row is judged for itself.  Only ``text`` is looked at.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, size)
        for batch in batches:
            guesses = [ranker.guess(text.as_py()) for text in batch.column(batch.schema.get_field_index("text"))]
            more = [pa.array([g[0] for g in guesses], pa.string()), pa.array([g[1] for g in guesses], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *more], [*batch.schema.names[: len(kept)], "lang_pred", "score"])

    rows = docs.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows if "text" in kept else docs.select(*kept, "text")  # a text that is not kept does not come back
    return shipped(rows).mapInArrow(scan, f"{fields}, lang_pred string, score double")


def known_only(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, least: float = MIN_NEARNESS) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text is in a language of ``profiles``.

    Rows without a letter go, and rows whose nearness to every profile is below ``least``: text in a script
    or language far from all profiles, or random letters.  While a profile has fewer than ``size`` n-grams, its
    language has been seen too little for distances to tell, and rows nearest to it stay; it changes nothing for rows nearer to others.  Without any
    profile nothing can be told, and every row with a text stays.  Each repeated row is judged for itself; an empty table gives no rows.
    """
    if not profiles:
        return docs.filter(F.col("text").isNotNull())
    short = sorted(name for name, profile in profiles.items() if len(profile) < size)
    clash = {c: f"_incidara_{c}" for c in docs.columns if c in ("lang_pred", "score")}
    marked = identify(docs.withColumnsRenamed(clash), profiles, size)
    marked = marked.filter((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= least) | F.col("lang_pred").isin(short))).drop("lang_pred", "score")
    return marked.withColumnsRenamed({new: old for old, new in clash.items()}).select(*docs.columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: a quarter of all, by its id's checksum."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))

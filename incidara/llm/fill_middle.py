"""Fill-in-the-middle: each text cut at two of its line ends, its parts in another order.

Identical texts are grouped by SHA-256, their bytes compared in the group.  For each different text the ends of
its lines are listed once, as an Elias-Fano list; the lists, a few bits a line, join the documents on the digest, and each
document picks its two cuts, which its id seeds.  Cuts and texts meet last, at the texts: their shuffle is the one
that grouping made already, so a text moves once, whatever the number of its copies, and copies in one task not at all.

Texts with a thousandth or more of all rows (at most a thousand of them, so their digests may be broadcast) are
handled apart: their documents are dealt over as many parts as they have thousandths.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.llm import elias_fano
from incidara.llm.support import settle, text_or_empty
from incidara.shipping import ship

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text with one row of so many is hot.
SHARE = 1000


def _line_ends(texts: pa.Array) -> pa.Array:
    """For each text how many lines and code points it has, and the Elias-Fano list of its lines' ends."""
    rows = []
    for text in texts.to_pylist():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.flatnonzero(points == 10) + 1
        if len(points) and (not len(ends) or ends[-1] != len(points)):
            ends = np.append(ends, len(points))
        rows.append({"n": len(ends), "chars": len(points), "ends": elias_fano.encode(ends, len(points))})
    return pa.array(rows, pa.struct([("n", pa.int64()), ("chars", pa.int64()), ("ends", pa.binary())]))


def _picked(ends: pa.Array, n: pa.Array, chars: pa.Array, lines: pa.Array) -> pa.Array:
    """Code points before the end of line number ``lines`` (0: none)."""
    given = zip(ends.to_pylist(), n.to_pylist(), chars.to_pylist(), lines.to_pylist(), strict=True)
    return pa.array([elias_fano.select(e, k, most, line - 1) if line else 0 for e, k, most, line in given], pa.int64())


def _digest(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``digest, text``, a row for each different text of ``docs`` (``digest, text``); two texts of one digest are an error."""
    grouped = docs.groupBy("digest").agg(F.collect_set("text").alias("texts"))
    one = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")))
    return grouped.select("digest", one.alias("text"))


def line_index(texts: DataFrame) -> DataFrame:
    """``digest, n, chars, ends`` of each different text."""
    ship(texts.sparkSession)
    line_ends = F.arrow_udf(_line_ends, "struct<n: long, chars: long, ends: binary>")
    return texts.select("digest", line_ends("text").alias("found")).select("digest", "found.*")


def _seeded(doc_id: Column, seed: int) -> list[Column]:
    """The four numbers that a document's id seeds."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return [F.conv(F.substring(F.sha2(name, 256), 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _cuts(rows: DataFrame, index: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """For each of ``rows`` its lines and the code points before its two cuts."""
    h, picked = _seeded(F.col("doc_id"), seed), F.arrow_udf(_picked, "long")
    joined = rows.join(index, keys)
    joined = joined.withColumn("_a", h[0] % (F.col("n") + 1)).withColumn("_b", h[1] % (F.col("n") + 1))
    at = lambda line: picked("ends", "n", "chars", line)
    return joined.select("doc_id", *keys, "n", at(F.least("_a", "_b")).alias("first"), at(F.greatest("_a", "_b")).alias("second"))


def _transformed(cut: DataFrame, seed: int, rate: int, spm: int) -> DataFrame:
    """The result columns of documents with their text and cuts."""
    h = _seeded(F.col("doc_id"), seed)
    marked = reduce(lambda a, b: a | b, [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle = F.substring("text", 1, first), F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_text = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    whole = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_text)
    cuts = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        "doc_id", "n", "form",
        F.when(cuts, F.col("first")).alias("prefix_chars"),
        F.when(cuts, F.col("second") - F.col("first")).alias("middle_chars"),
        whole.alias("output"),
    )


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, share: int = SHARE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs``.

    A text of ``n`` lines (a line has its line feed) is cut before or after any of them.  The form is ``plain``, the text as it is, if
    it is empty or has one of the marks, and for all but ``rate`` of a hundred documents; else ``spm`` (suffix first) for
    ``spm`` of a hundred and ``psm`` for the others.  Null text counts as empty.  A null id seeds like an empty one.
    Repeated rows give repeated rows; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", _digest(F.col("text")))
    rows = settle(texts.select("doc_id", "digest"))
    total = rows.count()
    # At most ``share`` texts have a row in ``share``: a bounded table, whatever the number of documents.
    counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") * share >= total)
    hot = F.broadcast(settle(counted.select("digest", F.ceil(F.col("rows") * share / F.lit(max(total, 1))).cast("int").alias("parts"))))

    cold = distinct_texts(texts.join(hot, "digest", "left_anti").select("digest", "text"))
    cut = _cuts(rows.join(hot, "digest", "left_anti"), line_index(cold), ["digest"], seed).join(cold, "digest")

    few = settle(distinct_texts(texts.join(hot, "digest", "left_semi").select("digest", "text")))
    dealt = lambda df: df.join(hot, "digest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    many = rows.join(hot, "digest").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
    keys = ["digest", "part"]
    hot_cut = _cuts(many, dealt(line_index(few)), keys, seed).join(dealt(few), keys)

    columns = ["doc_id", "n", "first", "second", "text"]
    done = _transformed(cut.select(*columns).unionByName(hot_cut.select(*columns)), seed, rate, spm)
    return done.withColumn("doc_id", F.col("doc_id").cast(ids))


def restore(done: DataFrame) -> DataFrame:
    """``done`` and ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    parts = F.split("output", "<[PSM]>", -1)  # the text has no mark, so there are four: nothing, then the parts in their order
    prefix, suffix = F.when(F.col("form") == "psm", parts[1]).otherwise(parts[2]), F.when(F.col("form") == "psm", parts[2]).otherwise(parts[1])
    return done.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat(prefix, parts[3], suffix)))

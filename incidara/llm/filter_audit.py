"""What each of several filters removes, in every order in which they could be applied.

A document's failures are bits of one number.  Each number meets all orders, a table that is broadcast as it
has 120 rows for five filters whatever the corpus; the place of the first failure settles what every step does with the
document.  Steps are counted by part, order and step, folded in each task before anything moves, so a part with
most of the documents leaves a task as 600 rows like any other.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidara.llm.exact_dedup import content_groups
from incidara.llm.support import text_or_empty

#: Limits of the filters: words, percent of different words, percent of capitals, symbols.
MIN_WORDS, MIN_DIFFERENT, MAX_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"


def own_failures(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides: too short, too repetitive, too many capitals, symbols."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    different = F.size(F.array_distinct(words)).cast("long")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * different < MIN_DIFFERENT * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, part, failed, good, toxic`` for each row of ``docs``; bit k of ``failed`` is the filter ``FILTERS[k]``.

    Null text counts as empty, null source as the empty string.  ``E`` fails a document whose text some smaller id has
    as well, compared byte by byte; a row without an id never fails it and has no labels.  Repeated rows are documents each.
    An id that several rows of ``labels`` name is good, or toxic, if one of them says so.  Other columns are ignored.
    """
    text = text_or_empty()
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(fails, 1 << FILTERS.index(f)).otherwise(0) for f, fails in own_failures(F.col("_text")).items()])
    own = docs.select("doc_id", text_or_empty("source").alias("part"), text.alias("_text")).select(
        "doc_id", "part", bits.alias("own"), F.unhex(F.md5("_text")).alias("content_hash"), F.sha2("_text", 256).alias("text_sha256")
    )
    again = F.when(F.col("keep_id") < F.col("doc_id"), 1 << FILTERS.index("E")).otherwise(0)
    rows = own.join(content_groups(docs.select("doc_id", "text"), "smallest"), ["content_hash", "text_sha256"])
    rows = rows.select("doc_id", "part", F.col("own").bitwiseOR(again).alias("failed"))
    if labels is None:
        return rows.select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(known, "doc_id", "left").select("doc_id", "part", "failed", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def orders(df: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``filter_order, step_1 ..``: every order of the filters and the bit of the filter at each step."""
    rows = [("".join(p), *(1 << filters.index(f) for f in p)) for p in permutations(filters)]
    fields = ", ".join(f"step_{k + 1} int" for k in range(len(filters)))
    return df.sparkSession.createDataFrame(rows, f"filter_order string, {fields}")


def replay(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` from ``failures``.

    All orders and steps of each part, zeros included; no documents give no rows.  ``shapley`` sums what the step's filter
    removes in all orders.
    """
    steps = [F.col(f"step_{k + 1}") for k in range(len(filters))]
    first = reduce(lambda later, k: F.when(F.col("failed").bitwiseAND(steps[k]) != 0, k + 1).otherwise(later), reversed(range(len(steps))), F.lit(len(steps) + 1))
    met = failed.crossJoin(F.broadcast(orders(failed, filters))).withColumn("first", first)
    each = met.select("part", "filter_order", "failed", "good", "toxic", "first", F.posexplode(F.array(*steps)).alias("place", "bit"))
    step, removed = F.col("place") + 1, F.col("first") == F.col("place") + 1
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    counted = each.groupBy("part", "filter_order", step.cast("int").alias("step")).agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(fails & (F.col("first") < step)).alias("redundant"),
        F.count_if(F.col("failed") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # A part has 120 rows of each filter here, whatever its documents.
    filter_rows = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counted.withColumn("shapley", F.sum("removed").over(filter_rows))

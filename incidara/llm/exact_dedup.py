"""Exact dedup: groups by 128-bit content hash, bytes compared inside each group.

``md5`` deals rows into groups; the text itself is the second grouping key, so two texts that
share a hash still form two groups.  Both keys go through one hash aggregation, which folds the
copies of a text on the map side: a text that a third of all rows repeat leaves each task once.
Rows then join their group on digests alone, so no copy of a text moves a second time, and a
hot digest is a plain skewed join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.llm.support import text_or_empty


def content_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row for each different text: its digests, the id that stays and the rows that share it."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    stays = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return (
        rows.groupBy(F.unhex(F.md5("text")).alias("content_hash"), "text")
        .agg(stays.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("content_hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def mark_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Null text counts as empty.  Rows that repeat an id and its text all have the same verdict.
    A row without an id stays only if no row of its group has one.  Other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        F.unhex(F.md5(text_or_empty())).alias("content_hash"),
        F.sha2(text_or_empty(), 256).alias("text_sha256"),
    )
    marked = rows.join(content_groups(docs, keep), ["content_hash", "text_sha256"])
    return marked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; texts move once, copies are folded before.

    One row of each text stays, also where rows repeat an id and its text, or have no id: of such rows the one whose other
    columns come first in order (columns that have none, as maps, do not count).  Null text counts as empty.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    named = docs.toDF(*["text" if c == "text" else f"_c{k}" for k, c in enumerate(columns)])
    at = {c: F.col("text") if c == "text" else F.col(f"_c{k}") for k, c in enumerate(columns)}
    orderable = [at[c] for c in others if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    doc_id = at["doc_id"]
    row = F.struct(F.col("text").isNull().alias("_no_text"), *[at[c] for c in others])
    rank = F.struct((doc_id.isNull() if keep == "smallest" else doc_id.isNotNull()).alias("_r"), doc_id.alias("_i"), F.col("text").isNull().alias("_n"), *orderable)
    best = (F.min_by if keep == "smallest" else F.max_by)(row, rank).alias("_row")
    text = text_or_empty()
    stay = named.groupBy(F.unhex(F.md5(text)).alias("_hash"), text.alias("_text")).agg(best)
    back = {"text": F.when(~F.col("_row._no_text"), F.col("_text")).alias("text")} | {c: F.col(f"_row._c{k}").alias(c) for k, c in enumerate(columns) if c != "text"}
    return stay.select(*[back[c] for c in columns])

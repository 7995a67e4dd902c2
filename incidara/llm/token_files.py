"""Token files: ids of documents in ascending id order, Simple-8b coded, and back.

Format: one row for a run of documents, in Parquet so that the writers' commit protocol covers
lost executors and any file system will do.  ``shard`` and ``chunk`` order the rows; ``doc_ids``
and ``counts`` name the documents of a run and their tokens; ``first`` is the number of ids before
it in its shard; ``words`` holds the 64-bit Simple-8b words, little-endian, and ``blocks`` the
32-bit offset of each block's first word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidara.llm import simple8b
from incidara.llm.support import text_or_empty
from incidara.llm.word_encoder import CODED_AT_ONCE, slices, word_encoder
from incidara.shipping import shipped

FORMAT = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, counts array<long>, words binary, blocks binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every text of ``docs`` and write the files to ``path``.

    ``tokenizer`` is the path of a vocabulary file on every machine.  Null text counts as empty and
    gives the end id alone; the string of a special token in a text becomes that token's id, as in the library.
    Rows with equal ids stand by text, repeated rows each for itself; rows without an id come first.
    Columns other than id and text are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        encoder = word_encoder(tokenizer, end_id)
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            for at, n in slices(texts, CODED_AT_ONCE):
                counts, ids = encoder.encode(texts.slice(at, n))
                words, blocks = simple8b.encode(ids)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                    "first": pa.array([first]), "n_ids": pa.array([len(ids)]),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), names.slice(at, n).cast(pa.int64())),
                    "counts": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(counts)),
                    "words": pa.array([words.astype("<u8").tobytes()]), "blocks": pa.array([blocks.astype("<u4").tobytes()]),
                })
                chunk, first = chunk + 1, first + len(ids)

    order = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange(order).sortWithinPartitions(order, "text")
    shipped(rows).mapInArrow(encode, FORMAT).write.mode("overwrite").option("compression", "zstd").parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """``shard, shard_start``: ids before each shard; one row for each partition that wrote."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")).alias("shard_start"))


def decode_row(words: bytes, blocks: bytes, n: int) -> np.ndarray:
    return simple8b.decode(np.frombuffer(words, "<u8"), np.frombuffer(blocks, "<u4"), n).astype(np.uint32)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, tokens array<int>`` of every document in the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_row(row["words"], row["blocks"], row["n_ids"])
                bounds = np.concatenate([[0], np.cumsum(row["counts"])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "tokens": pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))),
                })

    files = spark.read.schema(FORMAT).parquet(path)
    return shipped(files.select("n_ids", "doc_ids", "counts", "words", "blocks")).mapInArrow(decode, "doc_id long, tokens array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, all from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = decode_row(row["words"], row["blocks"], row["n_ids"]).astype("<u4")
                counts = np.asarray(row["counts"], np.int64)
                ends = np.cumsum(counts)
                sums = [zlib.crc32(raw[e - c : e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(len(counts), row["shard"], np.int32)), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "begin": pa.array(row["first"] + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(sums, pa.int64()),
                })

    files = spark.read.schema(FORMAT).parquet(path)
    found = shipped(files).mapInArrow(decode, "shard int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    placed = found.join(F.broadcast(shard_starts(files)), "shard")  # bounded: a row for each write task
    return placed.select("doc_id", (F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")

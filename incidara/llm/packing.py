"""Best-fit packing of documents into sequences: hierarchical residual packing.

Each task packs the pieces of its own partition, longest first, into the fullest sequence with room.
Sequences that are nearly full are final.  The others go up a tree as bins, where a node opens the bins it
gets and packs their pieces anew by best fit; again only underfull ones go on, to fewer nodes, until
one node has them all or a node would have more than ``NODE`` pieces.  A sequence has at least one
token of each of its pieces, so a bin with its pieces is a row of bounded size, and nothing has to be joined.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.llm.support import settle, text_or_empty
from incidara.llm.word_encoder import CODED_AT_ONCE, slices, word_encoder
from incidara.shipping import shipped

CAPACITY = 4096
#: Tokens that a sequence may lack and still be final at once.
SLACK = 4
#: Children of a node, and pieces that one node packs.
FAN = 8
NODE = 400_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut only where they exceed ``capacity``.

    Null text counts as empty and gives the end id alone; the string of a special token in a text becomes that
    token's id, as in the library.  Repeated rows and rows that share an id are cut each for itself; a null id
    stays null.  Columns other than id and text are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, end_id)
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            for at, n in slices(texts, CODED_AT_ONCE):
                counts, ids = encoder.encode(texts.slice(at, n))
                many = -(-counts // capacity)
                doc = np.repeat(np.arange(n), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                begin = (np.cumsum(counts) - counts)[doc] + start
                raw = np.ascontiguousarray(ids.astype("<u4"))
                sums = [zlib.crc32(raw[b : b + k]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [names.slice(at, n).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return shipped(rows).mapInArrow(encode, PIECE)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Places of ``lengths`` by bin: longest first, each into the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    order = np.argsort(-lengths, kind="stable")
    for place, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            here = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            here, room = len(bins), capacity
            bins.append([])
        bins[here].append(place)
        room -= length
        if room:
            by_room[room].append(here)
            rooms |= 1 << room
    return bins


def _pack_level(rows: DataFrame, level: int, capacity: int, slack: int, node: int) -> DataFrame:
    """One best-fit round over each partition of pieces, ``node`` of them at once: bins with their pieces in order."""

    def packed(items: pa.Table, first: int) -> pa.Table:
        lengths = items["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        order = np.fromiter((p for b in bins for p in b), np.int64, len(lengths))
        sizes = np.array([len(b) for b in bins], np.int64)
        which = np.repeat(np.arange(len(bins)), sizes)
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        fill = np.bincount(which, lengths[order]).astype(np.int64)
        out = items.take(pa.array(order))
        out = out.append_column("sequence_id", pa.array(first + which))
        out = out.append_column("offset", pa.array(begins - begins[np.cumsum(sizes) - sizes][which]))
        return out.append_column("final", pa.array(fill[which] >= capacity - slack)).combine_chunks()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = level << 56 | TaskContext.get().partitionId() << 28, [], 0
        for batch in itertools.chain(batches, [None]):
            if held and (batch is None or size + batch.num_rows > node):
                out = packed(pa.Table.from_batches(held), first)
                yield from out.to_batches(max_chunksize=50_000)
                first, held, size = out["sequence_id"][-1].as_py() + 1, [], 0
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.num_rows

    return shipped(rows).mapInArrow(pack, f"{PIECE}, sequence_id long, offset long, final boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan: int = FAN, node: int = NODE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece once, no sequence over ``capacity``.

    Nothing is dropped or cut here; a piece longer than ``capacity`` is an error of its maker.  Pieces of one
    length are placed in the order in which they come, so which of them share a sequence can differ between
    runs; repeated rows each have a place.  No pieces give no rows.
    """
    level, nodes = 0, max(1, pieces.rdd.getNumPartitions())
    packed = settle(_pack_level(pieces, level, capacity, slack, node))
    done = packed.filter("final")
    while nodes > 1:
        left = packed.filter("NOT final")
        size = left.count()
        fewer = max(1, -(-nodes // fan), -(-size // node))
        if fewer >= nodes:
            break
        level, nodes = level + 1, fewer
        # bins go to their node whole; the node opens them
        dealt = left.select(*_NAMES, "sequence_id").repartition(nodes, "sequence_id") if nodes > 1 else left.select(*_NAMES).coalesce(1)
        packed = settle(_pack_level(dealt.select(*_NAMES), level, capacity, slack, 2 * node))
        done = done.unionByName(packed.filter("final"))
    return done.unionByName(packed.filter("NOT final")).drop("final")

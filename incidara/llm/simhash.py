"""SimHash near-dedup: fingerprints, BK-trees over shards, and connected components.

Fingerprints within ``radius`` bits agree on some of the blocks that the bits are cut into, so a
shard for each choice of agreeing blocks holds every pair that can link, and a pair is missed by none.
Each shard has a BK-tree, whose children are keyed by their integer Hamming distance to the parent; a search
follows only edges within the radius of the distance at hand.  Equal fingerprints are one node before
any of this, so copies are never paired.

Trees are built where their shard's rows meet and are not broadcast: together they are as large as
the corpus.  A shard above ``SHARD`` fingerprints is dealt again by blocks of the bits still free,
which bounds it by the values that the last free bits can have.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.llm.components import connect, smallest_reached
from incidara.llm.support import settle, text_or_empty
from incidara.shipping import shipped

SEED = 42
#: Fingerprints in a shard above which it is dealt again.
SHARD = 4096
#: Rows of shards that a task takes at about once.
TASK_ROWS = 65_536
#: Shingles handled at once.
_AT_ONCE = 1 << 16


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of ``width`` words (A-Z lower-cased, ASCII white space between); all words if they are fewer."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return []
    if len(found) <= width:
        return [b" ".join(found)]
    return list(map(b" ".join, zip(*(found[k:] for k in range(width)), strict=False)))


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit that over half of the 64-bit hashes have."""
    totals = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        some = np.ascontiguousarray(hashes[at : at + _AT_ONCE], "<u8")
        totals += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, *names: str) -> DataFrame:
    """``names`` of ``docs`` and ``fp``, the fingerprint as a signed long; 0 for a text without words."""
    import xxhash

    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                parts = shingles(text.as_py(), width)
                if parts:
                    found[k] = fingerprint(np.fromiter(map(hashed, parts), np.uint64, len(parts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*names, "fp"])

    rows = docs.select(*names, text_or_empty().alias("_incidara_text"))
    fields = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)
    return shipped(rows).mapInArrow(scan, f"{fields}fp long")


class Tree:
    """A BK-tree over different fingerprints, in arrays; the first one is the root."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]  # (distance, node)
        todo = [(0, np.arange(1, len(values)))] if len(values) else []
        while todo:
            node, below = todo.pop()
            if not len(below):
                continue
            distances = np.bitwise_count(values[below] ^ values[node])
            for distance in np.unique(distances).tolist():
                branch = below[distances == distance]
                self.children[node].append((distance, int(branch[0])))
                todo.append((int(branch[0]), branch[1:]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node that some query is near, the node and the places of these queries.

        All queries go down together; each follows only edges within ``radius`` of its distance.
        """
        todo = [(0, np.arange(len(queries)))] if len(self.values) and len(queries) else []
        while todo:
            node, active = todo.pop()
            distances = np.bitwise_count(queries[active] ^ self.values[node]).astype(np.int64)
            near = active[distances <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node]:
                going = active[np.abs(distances - edge) <= radius]
                if len(going):
                    todo.append((child, going))


def local_links(values: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a shard, one fingerprint that stands for all it is linked to in the shard."""
    if len(values) == 2:
        return np.zeros(2, np.int64) if int(np.bitwise_count(values[0] ^ values[1])) <= radius else np.arange(2)
    found = [(np.full(len(near), node, np.int32), near.astype(np.int32)) for node, near in Tree(values).search(values, radius)]
    return smallest_reached(len(values), *(np.concatenate(side) for side in zip(*found, strict=True)))


def shard_masks(bits: int, start: int, radius: int) -> list[int]:
    """Masks of ``bits`` bits from ``start`` on: each leaves ``radius`` of ``radius + 2`` blocks out.

    Values that differ in at most ``radius`` of these bits agree under one of the masks at least.
    """
    blocks = radius + 2
    edges = [start + bits * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(prints: DataFrame, masks: list[int], *keys: str) -> DataFrame:
    """A row for each fingerprint and mask, with the fingerprint's bits under the mask."""
    places = F.array(*[F.struct(F.lit(k).alias("shape"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)])
    return prints.select("fp", *keys, F.inline(places))


def links(prints: DataFrame, radius: int, bits: int = 64, shard: int = SHARD) -> DataFrame:
    """Links ``a, b`` between the different values of ``fp``: enough to connect all within ``radius`` bits.

    A shard gives at most one link for each of its fingerprints, never its pairs.
    """
    whole = (1 << bits) - 1
    masks = shard_masks(bits, 0, radius)
    dealt = _keyed(prints, masks)
    sizes = settle(dealt.groupBy("shape", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))  # a large shard's join can then be split
    met = settle(dealt.join(sizes, ["shape", "value"]).select("fp", "shape", "n", F.xxhash64("shape", "value").alias("shard")))
    large = met.filter(F.col("n") > shard)
    found = _search(met.filter(F.col("n") <= shard).select("fp", "shard"), radius)
    if not large.isEmpty():
        # the bits free in a shard are those its mask leaves out; they are cut into blocks again
        again: Column | None = None
        for k, mask in enumerate(masks):
            free = [b for b in range(bits) if not mask >> b & 1]
            inner = [sum(1 << free[b] for b in range(len(free)) if chosen >> b & 1) | (mask & whole) for chosen in shard_masks(len(free), 0, radius)]
            keys = F.array(*[F.xxhash64(F.lit(j), "shard", F.col("fp").bitwiseAND(F.lit(_signed(m)))) for j, m in enumerate(inner)])
            again = F.when(F.col("shape") == k, keys) if again is None else again.when(F.col("shape") == k, keys)
        found = found.unionByName(_search(settle(large.select("fp", F.explode(again).alias("shard"))), radius))
    return found.distinct()


def _search(dealt: DataFrame, radius: int) -> DataFrame:
    """Links inside each ``shard`` of ``dealt``; a task takes whole shards, about ``TASK_ROWS`` rows of them."""

    def search(table: pa.Table) -> pa.Table:
        values, shards = table["fp"].to_numpy().view(np.uint64), table["shard"].to_numpy()
        order = np.lexsort((values, shards))
        values, shards = values[order], shards[order]
        edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]]))
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if end - begin < 2:
                continue
            some = values[begin:end]
            stands = local_links(some, radius)
            moved = stands != np.arange(len(some))
            a.append(some[moved])
            b.append(some[stands[moved]])
        return pa.table({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    tasks = max(1, -(-dealt.count() // TASK_ROWS))
    coarse = dealt.withColumn("task", F.pmod(F.xxhash64("shard", F.lit(7)), F.lit(tasks)))
    return shipped(coarse).groupBy("task").applyInArrow(search, "a long, b long")


def near_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs``.

    Documents link where their fingerprints differ in at most ``radius`` bits; a component is named by
    its smallest id (null if none of its rows has one).  Null text counts as empty; texts without a
    word have fingerprint zero and link like any other.  Columns other than id and text are ignored.
    """
    prints = settle(fingerprints(docs, width, "doc_id"))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connect(links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = settle(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))  # so that a large component's join can be split
    named = placed.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

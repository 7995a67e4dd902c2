"""Removal of near copies: SimHash and shared shingles find candidate pairs, five-word shingles decide each.

SimHash finds pairs that share few rare shingles early, so fewer keys are left open for the second round.  A five-word fingerprint puts texts of similarity 0.8 about ten of 64 bits
apart, too far for shards of agreeing bits, so the search uses fingerprints of single words, ``TABLES`` of
32 bits each; a BK-tree over each shard finds the texts within one bit, and a pair counts if the bits of all
tables together agree as well.  It misses pairs that differ in one long piece, and texts of few different words.

Prefix filtering misses none, with or without these: in any one order of all shingles, two texts of ``SIMILARITY`` have one in
common among the first fifth of each, and of the smaller one's first ninth.  These are join keys.  The order is by hash, after which come the
shingles that a sample of the texts has most, so that templates are keys only of texts made of them.

Pairs are decided one by one, in two rounds, so no group is ever expanded into its pairs:

1. each text with the first text of each key or shard that it has: as many pairs as there are rows;
2. keys whose texts the first round has not all connected: there every pair of texts of different groups,
   unless the key's places in both, sizes or sketches of the sets prove them too far apart.

A pair counts if the Jaccard similarity of its five-word shingles is at least ``SIMILARITY``; the smallest
id of each connected group stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.llm.components import connect
from incidara.llm.simhash import SEED, Tree, fingerprint, shard_masks, shingles
from incidara.llm.support import settle, text_or_empty
from incidara.llm.word_encoder import slices
from incidara.shipping import shipped

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of the wide fingerprint; each has two tables of 32 bits.
WORDS = 5
TABLES = 2 * WORDS
RADIUS = 1
#: Share of all bits that may differ within a pair.
APART = 0.2
#: Rows of one shard or key in a block; rows that a task takes at about once.
BLOCK, TASK_ROWS = 4096, 32_768
#: 64-bit words of the sketch of a set of shingles; a set of over ``LARGE`` members has a second one of two bits a member.
SKETCH, LARGE = 16, 512
#: One text of ``SAMPLE`` is looked at for shingles that over ``OFTEN`` of them have; so many of these are kept.
SAMPLE, OFTEN, FREQUENT = 16, 4, 16_384

_MIX = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WIDE, _SKETCH = [f"w{k}" for k in range(WORDS)], [f"s{k}" for k in range(SKETCH)]


def _hash(parts: list[bytes]) -> np.ndarray:
    """Different hashes of ``parts``, sorted."""
    import xxhash

    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64, len(parts)))


def wide_fingerprint(text: str, words: int = WORDS) -> np.ndarray:
    """SimHash of a text's different words, in 64-bit words of independent hashes."""
    hashes = _hash(shingles(text, 1))
    out = np.zeros(words, np.uint64)
    for k in range(words):
        mixed = hashes ^ _MIX[k]
        if k:
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
        out[k] = fingerprint(mixed)
    return out


def _prefix(size: int, similarity: float) -> int:
    """How many of a set's first members, in any one order of all, two sets of ``similarity`` cannot both have apart."""
    return size - math.ceil(similarity * size - 1e-6) + 1


def _sketch(hashes: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parities of the hashes' places: two sketches differ in at most as many bits as the sets in members.

    Halves of a sketch, bit by bit in exclusive or, are the sketch of half the ``words`` (a power of two).
    """
    places = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits(places & 1, bitorder="little").view(np.uint64)


def _large_sketch(hashes: np.ndarray) -> np.ndarray:
    return _sketch(hashes, 1 << ((len(hashes) - 1) // 32).bit_length()) if len(hashes) > LARGE else np.zeros(0, np.uint64)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, some megabytes at once: sets of shingles are larger than their texts."""
    for batch in batches:
        for at, n in slices(batch.column("text")):
            yield batch.column("id").slice(at, n), batch.column("text").slice(at, n).to_pylist()


def _listed(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(a.view(np.int64) for a in arrays)])))


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and how many of the sampled texts have each.

    They only order the keys; with any other numbers the same pairs are found.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64), *(_hash(shingles(t.as_py(), width)) for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text")
    counts = shipped(some).mapInArrow(scan, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = settle(counts.filter(F.col("n") > OFTEN).orderBy(F.desc("n"), "h").limit(FREQUENT)).collect()
    hashes = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in found], np.int64)[order]


def _first(hashes: np.ndarray, count: int, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first ``count`` of sorted ``hashes`` in the common order: by hash, but the frequent ones last."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[at] == hashes, often[at], 0)
        if rank.any():
            return hashes[np.lexsort((hashes, rank))[:count]]
    return hashes[:count]


def digests(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """For each row of ``docs`` (``id, text``): its wide fingerprint, and of its set of shingles the size, the sketches and the join keys."""
    frequent, often = _frequent(docs, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _sliced(batches):
            wide = np.array([wide_fingerprint(t) for t in texts], np.uint64).reshape(-1, WORDS).view(np.int64)
            sets = [_hash(shingles(t, width)) for t in texts]
            sketches = np.array([_sketch(h) for h in sets], np.uint64).reshape(-1, SKETCH).view(np.int64)
            keys = [_first(h, _prefix(len(h), similarity), frequent, often) for h in sets]
            columns = [ids, *map(pa.array, wide.T.copy()), pa.array(list(map(len, sets)), pa.int64()), *map(pa.array, sketches.T.copy())]
            columns += [_listed([_large_sketch(h) for h in sets]), _listed(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["id", *_WIDE, "size", *_SKETCH, "large", "keys"])

    fields = ", ".join(f"{name} long" for name in ["id", *_WIDE, "size", *_SKETCH])
    return settle(shipped(docs.select("id", "text")).mapInArrow(scan, f"{fields}, large array<long>, keys array<long>"))


def _in_tasks(rows: DataFrame, unit: str) -> DataFrame:
    """``rows`` with a coarse key ``task`` that has whole units, about ``TASK_ROWS`` rows for each."""
    rows = settle(rows)
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    return rows.withColumn("task", F.pmod(F.xxhash64(unit, F.lit(7)), F.lit(tasks)))


def _spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal keys of two and more."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    for k in np.flatnonzero(sizes > 1).tolist():
        yield int(edges[k]), int(edges[k + 1])


def _block_of(block: int) -> tuple[Column, Column]:
    """How many blocks the ``n`` rows of a key make, and the block of the row ``id``."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    return blocks, F.pmod(F.xxhash64("id", F.lit(block)), blocks).cast("int")


def _shard_links(values: np.ndarray, wide: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of a shard with near values and ``wide`` bits at most ``limit`` apart.

    The first row leads; rows that are not near it have their own leads.  So a row meets leads alone, and
    is linked to the first of those near it.
    """
    different, which = np.unique(values, return_inverse=True)
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(different) + 1))
    a, b = [], []
    for _, near in Tree(different).search(different, RADIUS):
        waiting = np.sort(np.concatenate([order[bounds[k] : bounds[k + 1]] for k in near.tolist()]))
        while len(waiting) > 1:
            lead, rest = waiting[0], waiting[1:]
            close = np.bitwise_count(wide[rest] ^ wide[lead]).sum(axis=1) <= limit
            a.append(np.full(int(close.sum()), lead))
            b.append(rest[close])
            waiting = rest[~close]
    empty = np.zeros(0, np.int64)
    leads, rows = np.concatenate([empty, *a]), np.concatenate([empty, *b])
    order = np.lexsort((leads, rows))
    rows, first = np.unique(rows[order], return_index=True)
    return leads[order][first], rows


def print_links(found: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of the ids of ``found`` (digests) whose wide fingerprints are near; at most one for each row of a shard.

    A shard above ``BLOCK`` rows is dealt to blocks, each with the shard's smallest id as a lead.
    """
    masks = shard_masks(32, 0, RADIUS)
    keys = []
    for table in range(TABLES):
        word = F.col(f"w{table // 2}")
        half = F.shiftrightunsigned(word, 32 * (table % 2)).bitwiseAND(F.lit((1 << 32) - 1))
        keys += [F.lit((table * len(masks) + k) << 32).bitwiseOR(half.bitwiseAND(F.lit(mask))) for k, mask in enumerate(masks)]
    prints = found.select("id", *_WIDE)
    dealt = prints.select("id", F.explode(F.array(*keys)).alias("key"))
    heads = settle(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).filter("n > 1"))
    blocks, mine = _block_of(BLOCK)
    spread = F.when(F.col("id") == F.col("lead"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))
    met = dealt.join(heads, "key").select("id", "key", F.explode(spread).alias("block")).join(prints, "id")
    limit = int(APART * 64 * WORDS)

    def search(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["id"].to_numpy(), table["shard"].to_numpy()))
        ids, shards, keys = (table[c].to_numpy()[order] for c in ("id", "shard", "key"))
        wide = np.stack([table[w].to_numpy()[order] for w in _WIDE], axis=1).view(np.uint64)
        tables = (keys >> 32) // len(masks)
        halves = wide[np.arange(len(ids)), tables // 2] >> (32 * (tables % 2)).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        spans = np.array(list(_spans(shards)), np.int64).reshape(-1, 2)
        two = spans[spans[:, 1] - spans[:, 0] == 2, 0]  # most shards have two rows: all at once
        two = two[np.bitwise_count(wide[two] ^ wide[two + 1]).sum(axis=1) <= limit]
        a, b = [two], [two + 1]
        for begin, end in spans[spans[:, 1] - spans[:, 0] > 2].tolist():
            x, y = _shard_links(halves[begin:end], wide[begin:end], limit)
            a.append(x + begin)
            b.append(y + begin)
        return pa.table({"a": ids[np.concatenate(a)], "b": ids[np.concatenate(b)]})

    tasks = _in_tasks(met.withColumn("shard", F.xxhash64("key", "block")), "shard")
    return shipped(tasks).groupBy("task").applyInArrow(search, "a long, b long").filter("a != b").distinct()


def _at_least(sizes: Column, similarity: float) -> Column:
    """Members in common that sets of so many members in all need for ``similarity``."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * sizes - F.lit(1e-6))


def key_rows(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``key, id, lead, place, size, short`` of the join keys that several rows of ``found`` (digests) have; the lead is the key's smallest id.

    ``place`` is the key's in the row's set.  The smaller of two sets of ``similarity`` has their first common member in an
    even shorter prefix than the larger one; ``short`` says whether the key is in that.
    """
    dealt = found.select("id", "size", F.posexplode("keys").alias("place", "key"))
    heads = settle(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).filter("n > 1"))
    short = F.col("place") <= F.col("size") - _at_least(2 * F.col("size"), similarity)
    return settle(dealt.join(heads, "key").select("key", "id", "lead", "place", "size", short.alias("short")))


def _apart(similarity: float) -> float:
    """Share of both sizes by which two sets of ``similarity`` can differ at most."""
    return (1 - similarity) / (1 + similarity)


def _may_link(sizes: np.ndarray, sketches: np.ndarray, a: np.ndarray | int, b: np.ndarray, apart: float) -> np.ndarray:
    """Which sets ``b`` can be within the share ``apart`` of both sizes of the sets ``a``; no pair that is gets lost."""
    differ = np.bitwise_count(sketches[b] ^ sketches[a]).sum(axis=-1)
    return np.maximum(differ, np.abs(sizes[b] - sizes[a])) <= apart * (sizes[b] + sizes[a]) + 1e-5


def _halved(sketch: Column) -> Column:
    half = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, 1, half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def possible(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` that sizes and sketches in ``found`` (digests) do not rule out."""
    side = lambda name, *columns: found.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    most = lambda: F.lit(_apart(similarity)) * (F.col("a_size") + F.col("b_size")) + 1e-5
    both = pairs.join(side("a", "size", *_SKETCH), "a").join(side("b", "size", *_SKETCH), "b")
    differ = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _SKETCH), F.lit(0))
    near = both.filter(F.greatest(differ, F.abs(F.col("a_size") - F.col("b_size"))) <= most())
    near = settle(near.select("a", "b", F.least("a_size", "b_size").alias("size")).distinct())
    small, large = near.filter(F.col("size") <= LARGE), near.filter(F.col("size") > LARGE).select("a", "b")
    both = large.join(side("a", "size", "large"), "a").join(side("b", "size", "large"), "b")
    a, b = F.col("a_large"), F.col("b_large")  # at these sizes one is at most twice as long
    a, b = F.when(F.size(a) > F.size(b), _halved(a)).otherwise(a), F.when(F.size(b) > F.size(a), _halved(b)).otherwise(b)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return small.select("a", "b").unionByName(both.filter(differ <= most()).select("a", "b")).distinct()


def decide(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose texts' shingles agree to ``similarity``; ``docs`` has ``id, text``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _sliced(batches):
            yield pa.RecordBatch.from_arrays([ids, _listed([_hash(shingles(t, width)) for t in texts])], ["id", "hashes"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = settle(shipped(docs.select("id", "text").join(ids, "id", "left_semi")).mapInArrow(hashed, "id long, hashes array<long>"))
    side = lambda name: sets.select(F.col("id").alias(name), F.col("hashes").alias(f"{name}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.filter(common >= similarity * (F.size("a_set") + F.size("b_set") - common) - 1e-6).select("a", "b").distinct()


def _may_share(size: int, place: int, sizes: np.ndarray, places: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets can reach ``similarity`` with one if a key at these places is the first that both have.

    Nothing before it is common, so what is from there on bounds the members in common.
    """
    most = np.minimum(size - place, sizes - places)
    return most >= similarity / (1 + similarity) * (size + sizes) - 1e-6


def open_pairs(rows: DataFrame, found: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of different ``groups`` (``node, root``) that share a key of ``rows`` and that places, sizes and sketches do not rule out.

    In a key only short rows meet others, as the smaller of the two; a key that no row has in its short prefix, as that of a
    template which all texts have at their ends, makes no pairs.  Rows and short rows of a key are dealt to blocks; each block of the ones
    meets each of the others, so what a task holds at once is bounded.
    """
    named = rows.join(groups, rows["id"] == groups["node"], "left").select("key", "id", "place", "size", "short", F.coalesce("root", "id").alias("root"))
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("n_short"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = settle(mixed.filter("low != high AND n_short > 0").select("key", "n", "n_short"))
    of = lambda count: F.ceil(F.col(count) / BLOCK).cast("int")
    mine = lambda count: F.pmod(F.xxhash64("id", F.lit(BLOCK)), of(count)).cast("int")
    met = named.join(mixed, "key")
    as_other = F.transform(F.sequence(F.lit(0), of("n_short") - 1), lambda k: F.struct(mine("n").alias("home"), k.alias("lead"), F.lit(False).alias("leads")))
    as_lead = F.transform(F.sequence(F.lit(0), of("n") - 1), lambda k: F.struct(k.alias("home"), mine("n_short").alias("lead"), F.lit(True).alias("leads")))
    met = met.withColumn("b", F.explode(F.when(F.col("short"), F.concat(as_other, as_lead)).otherwise(as_other)))
    met = met.select("id", "root", "place", F.col("b.leads").alias("leads"), F.xxhash64("key", "b.home", "b.lead").alias("pair"))
    met = met.join(found.select("id", "size", *_SKETCH), "id")
    apart = _apart(similarity)

    def search(table: pa.Table) -> pa.Table:
        order = np.lexsort(tuple(table[c].to_numpy() for c in ("id", "size", "pair")))
        ids, roots, pairs, sizes, places, leads = (table[c].to_numpy()[order] for c in ("id", "root", "pair", "size", "place", "leads"))
        sketches = np.stack([table[s].to_numpy()[order] for s in _SKETCH], axis=1).view(np.uint64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, end in _spans(pairs):
            for lead in (begin + np.flatnonzero(leads[begin:end])).tolist():
                last = begin + int(np.searchsorted(sizes[begin:end], sizes[lead] / similarity + 1e-6, "right"))
                first = begin + int(np.searchsorted(sizes[begin:end], sizes[lead], "left"))
                rest = first + np.flatnonzero(~leads[first:last] & (roots[first:last] != roots[lead]))
                rest = rest[_may_share(int(sizes[lead]), int(places[lead]), sizes[rest], places[rest], similarity)]
                rest = rest[_may_link(sizes, sketches, lead, rest, apart)]
                a.append(np.full(len(rest), lead))
                b.append(rest)
        one, other = ids[np.concatenate(a)], ids[np.concatenate(b)]
        return pa.table({"a": np.minimum(one, other), "b": np.maximum(one, other)})

    return shipped(_in_tasks(met, "pair")).groupBy("task").applyInArrow(search, "a long, b long").distinct()


def near_groups(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` of every document of ``docs`` (``doc_id, text``) that has a near copy; the root stays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("text").rlike("[^ \\t-\\r]"))
    found = digests(rows, width, similarity)
    keyed = key_rows(found, similarity)
    first = keyed.filter("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    tried = settle(possible(first.unionByName(print_links(found)).distinct(), found, similarity))
    links = settle(decide(tried, rows, width, similarity))
    groups = connect(links)
    left = settle(possible(open_pairs(keyed, found, groups, similarity).join(tried, ["a", "b"], "left_anti"), found, similarity))
    if left.isEmpty():
        return groups
    return connect(links.unionByName(decide(left, rows, width, similarity)))


def drop_near_copies(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the smallest id.

    Rows without an id or without a word (null, empty or white-space text) stay.  Rows that share an id are
    one document: what is linked to one of them is linked to all.  Repeated rows stay or go together; of
    two texts that are near copies of a third, both go even where they are not near each other.
    """
    away = near_groups(docs, width, similarity).filter("node != root").select(F.col("node").alias("_incidara_node"))
    return docs.join(away, docs["doc_id"] == away["_incidara_node"], "left_anti").select(*docs.columns)

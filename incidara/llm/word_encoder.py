"""Token ids by the tokenizers library, with each different word of a batch encoded once.

A tokenizer that drops white space never looks across it, so the ids of a text are the ids of its
words in turn.  A byte-level one joins white space to what follows, so there the units are runs of
white space with the word after them.  A batch is cut into units and dictionary-encoded by Arrow;
the library sees only the units that the worker has not met, and numpy lays the ids out by document.
A text that holds the string of a special token is given to the library whole, as it finds these in raw text.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker remembers, and characters in them, before the older half goes.
REMEMBERED, REMEMBERED_CHARACTERS = 500_000, 32_000_000
#: Characters handled at once: bounds a worker's memory whatever the batch.
AT_ONCE = 2_000_000
#: The same where numpy alone handles the ids: each slice looks its units up in all that are known.
CODED_AT_ONCE = 2 * AT_ONCE
#: Words given to the library at once, and words of plain letters in one text.
CALL, TOGETHER = 4_000, 500


def words(texts: pa.Array) -> pa.LargeListArray:
    """The words of each text, white space dropped."""
    return pc.ascii_split_whitespace(texts)


def lowered_words(texts: pa.Array) -> pa.LargeListArray:
    """The words of each text for a tokenizer that lowers case and splits letters from marks.

    A-Z are lowered here already, and marks that end a word stand apart, as the tokenizer would
    have them: far fewer different units are left.  A text with a combining mark on one of A-Z keeps its
    case, as the tokenizer composes characters before it lowers them.
    """
    marks_apart = pc.replace_substring_regex(texts, r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)(\s|$)", r"\1 \2\3")
    lowered = pc.ascii_lower(marks_apart)  # in this order: ascii_lower misreads slices
    composed = pc.match_substring_regex(texts, r"[A-Z]\p{M}")
    return pc.ascii_split_whitespace(pc.if_else(composed, marks_apart, lowered) if pc.any(composed).as_py() else lowered)


def units_of(tokenizer):
    """The coarsest cut into units that a tokenizer's own normalizer and split allow."""
    parts = json.loads(tokenizer.to_str())
    steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
    splits = [p.get("pattern", {}).get("Regex", "") for p in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return lowered_words if "Lowercase" in steps and any(r"[\p{L}]+" in s and r"[^\s\p{L}\p{N}]+" in s for s in splits) else words


def word_ends(tokenizer) -> np.ndarray | None:
    """For each id whether its token ends a word, where the vocabulary tells; else None."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


class WordEncoder:
    """Encodes batches of texts unit by unit; ``end_id``, if any, is appended to each text."""

    def __init__(self, tokenizer, end_id: int | None, units=words):
        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self.units = units
        self.word_ends = word_ends(tokenizer) if units is lowered_words else None
        self.known = pa.array([], pa.large_string())
        self.starts, self.pool = np.zeros(1, np.int32), np.zeros(0, np.uint32)  # ids of the known units

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, and all ids in a row."""
        sizes, packed = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        for at in range(0, len(texts), CALL):
            found = self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)
            ids = [array("I", f.ids) for f in found]
            sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            packed.append(np.frombuffer(b"".join(ids), np.uint32))
        return np.concatenate(sizes), np.concatenate(packed)

    def _ids_together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for units of plain letters, many in one text: each is one word, and ends with the token that ends a word."""
        _, ids = self._ids([" ".join(units[at : at + TOGETHER]) for at in range(0, len(units), TOGETHER)])
        ends = np.flatnonzero(self.word_ends[ids])
        if len(ends) != len(units):
            return self._ids(units)
        return np.diff(ends, prepend=-1).astype(np.int32), ids

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember units; their places among the known."""
        before = len(self.known)
        plain = np.zeros(len(new), bool)
        if self.word_ends is not None:
            plain = pc.match_substring_regex(new, "^[a-z]+$").to_numpy(zero_copy_only=False)
        order = np.argsort(~plain, kind="stable")
        new = new.take(pa.array(order))
        units, many = new.to_pylist(), int(plain.sum())
        some, ids = self._ids_together(units[:many]) if many else self._ids([])
        others, other_ids = self._ids(units[many:])
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.cumsum(np.concatenate([[0], np.diff(self.starts), some, others]), dtype=np.int32)
        self.pool = np.concatenate([self.pool, ids, other_ids])
        places = np.empty(len(new), np.int32)
        places[order] = np.arange(before, len(self.known), dtype=np.int32)
        return places

    def _forget(self) -> None:
        if len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_CHARACTERS:
            half = len(self.known) // 2
            self.pool = self.pool[self.starts[half] :].copy()
            self.starts = self.starts[half:] - self.starts[half]
            self.known = pa.concat_arrays([self.known[half:], pa.array([], pa.large_string())])

    def _unit_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and all ids in a row, by way of its units."""
        lists = self.units(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self._forget()
        places = pc.index_in(coded.dictionary, value_set=self.known)
        if places.null_count:
            learned = self._learn(coded.dictionary.filter(pc.is_null(places)))
            places = pc.replace_with_mask(places, pc.is_null(places), pa.array(learned))
        all_ids = pa.ListArray.from_arrays(pa.array(self.starts), pa.array(self.pool))
        placed = all_ids.take(places.take(coded.indices))  # the ids of each unit in its place
        ids, upto = placed.flatten().to_numpy(), placed.offsets.to_numpy().astype(np.int64)
        return upto[bounds[1:] - bounds[0]] - upto[bounds[:-1] - bounds[0]], ids

    def _with_special(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold the string of a special token, in any case as units are lowered before the library sees them."""
        found = np.zeros(len(texts), bool)
        for content in self.special:
            found |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and all ids in a row."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = self._with_special(texts)
        if special.any():
            counts, plain = self._unit_ids(pc.if_else(pa.array(special), "", texts))
            sizes, whole = self._ids(texts.filter(pa.array(special)).to_pylist())
            counts = counts.copy()
            counts[special] = sizes
            of_special = np.repeat(special, counts)
            ids = np.empty(len(of_special), np.uint32)
            ids[of_special], ids[~of_special] = whole, plain
        else:
            counts, ids = self._unit_ids(texts)
        pa.default_memory_pool().release_unused()  # else a worker keeps several slices' worth
        if self.end_id is None:
            return counts, ids
        counts = counts + 1
        out = np.full(len(ids) + len(counts), self.end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(counts) - 1] = False
        out[inside] = ids
        return counts, out


@lru_cache(maxsize=4)
def word_encoder(path: str, end_id: int | None) -> WordEncoder:
    """One encoder for each worker and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return WordEncoder(tokenizer, end_id, units_of(tokenizer))


def slices(texts: pa.Array, at_once: int = AT_ONCE):
    """``(from, length)`` of runs of rows with about ``at_once`` characters; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    begin = held = 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > at_once:
            yield begin, at - begin
            begin, held = at, 0
        held += size
    if len(sizes) > begin:
        yield begin, len(sizes) - begin

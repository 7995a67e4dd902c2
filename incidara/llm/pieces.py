"""SentencePiece BPE by a merge-type prefix table, and decoding by the library.

The table holds for each prefix of a text the last token of that prefix's encoding.  There is exactly one:
the token that ends there (an automaton over the vocabulary names all that do) and is compatible with
the last token of the prefix before it.  Two tokens are compatible if merging never joins anything across
the border between them, which is settled once a pair from the merges that made each of the two.
The ids are read off the table from its end.  Time grows with the text, whatever its words.

Texts are cut where no vocabulary entry crosses (before a space, between letters and other characters), and a
worker fills the table once for each different unit.  Characters outside the vocabulary become the ids of their bytes.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from incidara.llm.support import text_or_empty
from incidara.llm.word_encoder import WordEncoder, slices
from incidara.shipping import shipped

#: What stands for a space in the vocabulary.
SPACE = "▁"
#: Pairs of tokens that a worker remembers.
PAIRS = 2_000_000
#: Characters handled at once; each is a Python string's worth of units.
PIECES_AT_ONCE = 1_000_000
_OUTSIDE = -1
_NEVER = float("inf")


@lru_cache(maxsize=4)
def library(path: str):
    """The library's processor, loaded once a worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))


class MergeTable:
    """Vocabulary of a merge model: which token ends a prefix, and which two tokens may stand side by side."""

    def __init__(self, processor):
        size = processor.get_piece_size()
        kinds = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) for i in range(size)]
        if any(processor.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        self.byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if len(set(self.byte_ids)) != 256 or not all(map(processor.is_byte, self.byte_ids)):
            raise ValueError("the model has no byte fallback")
        self.size = size
        self.ids = {processor.id_to_piece(i): i for i in range(size) if not kinds[i]}
        self.lengths = [0] * size
        for piece, i in self.ids.items():
            self.lengths[i] = len(piece)
        self.order = [-processor.get_score(i) for i in range(size)]  # least first
        characters = {c for piece in self.ids for c in piece}
        if not characters <= self.ids.keys():
            raise ValueError("a piece has a character that is no piece")
        self.steps = [None] * size
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.steps[i] = self._made_of(piece)
            if self.steps[i] is not None:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.unit = self._unit_pattern(characters)

    def _made_of(self, piece: str) -> list[tuple] | None:
        """The merges that make a token, in turn: ``(order, first symbol after it, last symbol after it)``; None if merging makes others of it.

        The first step has no merge: it names the characters at both ends.
        """
        symbols = list(piece)
        steps = [(-_NEVER, symbols[0], symbols[-1])]
        while len(symbols) > 1:
            joined = [(self.order[i], k) for k in range(len(symbols) - 1) if (i := self.ids.get(symbols[k] + symbols[k + 1])) is not None]
            if not joined:
                return None
            order, k = min(joined)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            steps.append((order, symbols[0], symbols[-1]))
        return steps

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens gives these two: no pair across the border ever comes first.

        Of merges of equal order the leftmost comes first: those of ``left``, then the border's, then those of ``right``.
        """
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        mine, theirs, i, k = self.steps[left], self.steps[right], 0, 0
        while True:
            across = self.ids.get(mine[i][2] + theirs[k][1])
            next_mine = mine[i + 1][0] if i + 1 < len(mine) else _NEVER
            next_theirs = theirs[k + 1][0] if k + 1 < len(theirs) else _NEVER
            if across is not None and self.order[across] < next_mine and self.order[across] <= next_theirs:
                return False
            if next_mine == next_theirs == _NEVER:
                return True
            if next_mine <= next_theirs:
                i += 1
            else:
                k += 1

    def _unit_pattern(self, characters: set[str]) -> re.Pattern:
        """Runs that no piece crosses: spaces with the letters, or with the other characters, after them.

        White space that is no piece stands apart, so words at the ends of lines are the same units as others.  Where
        pieces mix letters and other characters, or go on over spaces, units are larger.
        """
        bodies = [piece.lstrip(SPACE) for piece in self.ids]
        if any(SPACE in body for body in bodies):
            return re.compile(r"[\s\S]+")
        apart = "".join(c for c in "\n\r\t" if c not in characters)
        runs = [rf"[^{SPACE}{apart}]+"]
        if all(body.isalpha() or not any(map(str.isalpha, body)) for body in bodies):
            numbers = "".join(sorted(c for c in characters if not c.isalpha() and re.match(r"[^\W\d_]", c)))
            runs = [rf"[^\W\d_{SPACE}{numbers}]+", rf"(?:[\W\d_{numbers}](?<![{SPACE}{apart}]))+"]
        return re.compile(rf"{SPACE}*(?:{'|'.join(runs)})|{SPACE}+" + (f"|[{apart}]+" if apart else ""))

    def encode(self, unit: str) -> list[int]:
        """Ids of a unit, by the table of its prefixes."""
        last = [_OUTSIDE] * (len(unit) + 1)
        pairs, size = self.pairs, self.size
        for end, (token, length) in self.automaton.iter(unit):
            if last[end + 1] == _OUTSIDE:
                before = last[end + 1 - length]
                if before == _OUTSIDE:  # the start, or after a character outside the vocabulary
                    last[end + 1] = token
                else:
                    fits = pairs.get(before * size + token)
                    if fits or (fits is None and self.compatible(before, token)):
                        last[end + 1] = token
        ids, at, lengths = [], len(unit), self.lengths
        while at:
            token = last[at]
            if token == _OUTSIDE:
                ids += [self.byte_ids[b] for b in reversed(unit[at - 1].encode())]
                at -= 1
            else:
                ids.append(token)
                at -= lengths[token]
        ids.reverse()
        return ids


class PieceEncoder(WordEncoder):
    """Encodes batches of texts, each different unit once."""

    def __init__(self, table: MergeTable):
        self.table, self.special, self.end_id, self.word_ends = table, [], None, None
        self.known = pa.array([], pa.large_string())
        self.starts, self.pool = np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def units(self, texts: pa.Array) -> pa.LargeListArray:
        find = self.table.unit.findall
        found = [find(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array([u for x in found for u in x], pa.large_string()))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(self.table.encode, texts))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return sizes, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker and model."""
    return PieceEncoder(MergeTable(library(path)))


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = piece_encoder(path)
    for batch in batches:
        names, texts = batch.column("doc_id"), batch.column("text")
        for at, n in slices(texts, PIECES_AT_ONCE):
            counts, ids = encoder.encode(texts.slice(at, n))
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([names.slice(at, n), pa.array(counts.astype(np.int64)), lists], ["doc_id", "n_tokens", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    processor = library(path)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        content = [processor.decode(row) if row else "" for row in ids.to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.string())], [*batch.schema.names, "content"])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each row's decimal ids, joined by commas, and of its decoded text."""
    sha = lambda column: pa.array([hashlib.sha256(value or b"").hexdigest() for value in column.cast(pa.binary()).to_pylist()], pa.string())
    for batch in batches:
        names, counts, ids, content = batch.columns
        decimal = pc.binary_join(ids.cast(pa.list_(pa.string())), ",")
        yield pa.RecordBatch.from_arrays([names, counts, sha(decimal), sha(content)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """Ids and texts, and the fields of encoded rows."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")), f"doc_id {kind}, n_tokens long, ids array<int>"


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text by the model file ``path``, which every executor has.

    No begin or end ids.  Null text counts as empty and has no ids.  Repeated rows and rows that share an id are encoded
    each for itself; a null id stays null.  The strings of control pieces are ordinary text, as in the library.
    Columns other than id and text are ignored; an empty table gives no rows.
    """
    rows, fields = _texts(docs)
    return shipped(rows).mapInArrow(lambda batches: _encode_batches(batches, path), fields)


def decode_pieces(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` and ``content``, the text of its ``ids`` by the library; null ids and empty ones give an empty text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return shipped(coded).mapInArrow(lambda batches: _decode_batches(batches, path), f"{fields}, content string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode_pieces`` and ``decode_pieces`` of its ids in one pass of the tasks."""
    rows, fields = _texts(docs)
    return shipped(rows).mapInArrow(lambda batches: _decode_batches(_encode_batches(batches, path), path), f"{fields}, content string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of what ``round_trip`` returns, taken where it is made, so ids and texts stay there."""
    rows, fields = _texts(docs)
    made = lambda batches: _digest_batches(_decode_batches(_encode_batches(batches, path), path))
    return shipped(rows).mapInArrow(made, fields.replace("ids array<int>", "ids_sha256 string, decoded_sha256 string"))

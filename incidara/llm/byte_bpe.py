"""Byte-level BPE by a rank file: encoding through the tokenizers library, and decoding.

The rank file has bytes; the library has characters.  Each byte stands for one printable character,
and every way to make a token of two others is a merge, in the order of the tokens' ranks, which is
the order in which ranks alone would merge.  Decoding reverses the byte table; a character that two
tokens share comes back whole, and bytes that are no UTF-8 become U+FFFD in the text alone.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.llm.support import text_or_empty
from incidara.llm.word_encoder import WordEncoder, slices
from incidara.shipping import shipped

#: Unicode white space, as the split pattern's ``\\s`` has it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from lines of base64 and number."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def units(texts: pa.Array) -> pa.LargeListArray:
    """Runs of white space with the word after them: no pre-token crosses from one to the next."""
    found = [_UNIT.findall(text) for text in texts.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array([u for x in found for u in x], pa.large_string()))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> WordEncoder:
    """The library's tokenizer for a rank file, built once a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table, letters = ranks(path), byte_characters()
    spelt = {token: "".join(letters[b] for b in token) for token in table}
    merges = []
    for token in sorted((t for t in table if len(t) > 1), key=table.__getitem__):
        halves = [(token[:k], token[k:]) for k in range(1, len(token))]
        halves = [h for h in halves if h[0] in table and h[1] in table]
        merges += [(spelt[a], spelt[b]) for a, b in sorted(halves, key=lambda h: (table[h[0]], table[h[1]]))]
    tokenizer = Tokenizer(models.BPE({spelt[t]: r for t, r in table.items()}, merges))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return WordEncoder(tokenizer, None, units)


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """Bytes of each id."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


def char_starts(ids: np.ndarray, table: list[bytes]) -> np.ndarray:
    """For each id of a text, the place of the character that its first byte is part of."""
    raw = np.frombuffer(b"".join(map(table.__getitem__, ids.tolist())), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    sizes = np.fromiter((len(table[i]) for i in ids.tolist()), np.int64, len(ids))
    begins = np.cumsum(sizes) - sizes
    return character[begins].astype(np.int32) if len(ids) else np.zeros(0, np.int32)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    coder, table = encoder(path, pattern), byte_table(path)
    for batch in batches:
        names, texts = batch.column("doc_id"), batch.column("text")
        for at, n in slices(texts):
            counts, ids = coder.encode(texts.slice(at, n))
            raw = np.ascontiguousarray(ids.astype("<u4")).tobytes()
            ends = np.cumsum(counts).tolist()
            spans = list(zip([0, *ends], ends, strict=False))
            out = [names.slice(at, n), pa.array(counts), pa.array([raw[4 * a : 4 * b] for a, b in spans], pa.binary())]
            if offsets:
                out.append(pa.array([char_starts(ids[a:b], table) for a, b in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "char_starts"][: len(out)])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = byte_table(path)
    for batch in batches:
        packed = batch.column(batch.schema.get_field_index("ids")).to_pylist()
        content = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in packed]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary())], [*batch.schema.names, "content"])


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """Ids and texts, and the fields of encoded rows."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")), f"doc_id {kind}, n_tokens long, ids binary"


def encode_texts(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of every text.

    With ``offsets`` also ``char_starts array<int>``.  Null text counts as empty and has no ids;
    special tokens' strings are ordinary text.  Columns other than id and text are ignored.
    """
    rows, fields = _texts(docs)
    return shipped(rows).mapInArrow(lambda batches: _encode_batches(batches, path, pattern, offsets), fields + ", char_starts array<int>" * offsets)


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` and ``content``, the bytes that its ``ids`` stand for; null ids have no bytes."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return shipped(coded).mapInArrow(lambda batches: _decode_batches(batches, path), f"{fields}, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode_texts`` and ``decode_ids`` of its ids in one pass of the tasks.

    Null text counts as empty: no ids and no bytes.  A null id stays null; repeated rows are coded each for itself; no rows give none.
    """
    rows, fields = _texts(docs)
    return shipped(rows).mapInArrow(lambda batches: _decode_batches(_encode_batches(batches, path, pattern, False), path), f"{fields}, content binary")


def as_text(content: Column) -> Column:
    """Decoded bytes as text; what is no UTF-8 (ids cut inside a character) becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))

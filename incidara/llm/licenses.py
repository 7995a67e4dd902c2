"""License scans: notice phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

A text becomes its words (A-Z lower-cased, ASCII letters, digits and all other characters beyond
ASCII), joined by spaces; the automaton finds phrases between spaces, so a phrase's words stand
consecutively whatever punctuation was between.  Behind an identifier tag the rest of the line, but for
the end of a comment, is an expression of known identifiers, ``and``, ``or``, ``with`` and parentheses; with
anything else in it, it counts for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.llm.support import text_or_empty
from incidara.shipping import shipped

#: Fixed phrases and labels whose places are counted.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Further notices; of two that begin together the longer is taken.
NOTICES = (
    ("apache license version 2 0", "apache-2.0"),
    ("general public license version 2", "gpl-2.0"),
    ("general public license version 3", "gpl-3.0"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("isc license", "isc"),
    ("boost software license", "bsl-1.0"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons zero", "cc0-1.0"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("all rights reserved", "proprietary"),
)
_CC = [f"cc-by{kind}-{version}" for kind in ("", "-sa", "-nd", "-nc", "-nc-sa", "-nc-nd") for version in ("1.0", "2.0", "2.5", "3.0", "4.0")]
#: The names with their versions as notices: "cc by 4 0".
VERSIONED = tuple((label.replace("-", " ").replace(".", " "), label) for label in ["cc0-1.0", *_CC])
#: Words that make a phrase a statement of licensing.
GRANTS = ("licensed under", "released under", "distributed under", "under the terms of", "available under")
TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier:([^\n\r]*)", re.IGNORECASE)
#: What ends a comment, and so may stand behind an expression.
COMMENT_ENDS = ("*/", "-->", "*)", "#}", "-}", '"""', "'''", '"', "'")
_PIECE = re.compile(r"[ \t]*([()]|[a-z0-9.+:-]+|.)")
#: Identifiers that an expression may name, without ``+``, ``-only`` and ``-or-later`` (fixed values).
IDENTIFIERS = frozenset(
    (
        "0bsd", "afl-3.0", "agpl-3.0", "apache-1.1", "apache-2.0", "apsl-2.0", "artistic-1.0", "artistic-2.0", "bsd-1-clause", "bsd-2-clause",
        "bsd-3-clause", "bsd-4-clause", "bsl-1.0", "cc0-1.0", "cddl-1.0", "cddl-1.1", "cecill-2.1", "cpl-1.0", "ecl-2.0", "epl-1.0", "epl-2.0",
        "eupl-1.1", "eupl-1.2", "fdl-1.3", "gfdl-1.1", "gfdl-1.2", "gfdl-1.3", "gpl-1.0", "gpl-2.0", "gpl-3.0", "hpnd", "isc", "lgpl-2.0",
        "lgpl-2.1", "lgpl-3.0", "libpng-2.0", "lppl-1.3c", "mit", "mit-0", "mpl-1.0", "mpl-1.1", "mpl-2.0", "ms-pl", "ms-rl", "mulanpsl-2.0",
        "ncsa", "odbl-1.0", "ofl-1.1", "osl-3.0", "php-3.01", "postgresql", "python-2.0", "ruby", "sspl-1.0", "unicode-3.0", "unlicense", "upl-1.0",
        "vim", "w3c", "wtfpl", "x11", "zlib", "zpl-2.1", *_CC,
    )
)
#: What may stand after ``with`` (fixed values).
EXCEPTIONS = frozenset(
    (
        "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-3.1", "gpl-cc-1.0",
        "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception-1.0", "qt-gpl-exception-1.0", "swift-exception", "u-boot-exception-2.0",
    )
)
_REFERENCE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_VERSION_SUFFIX = re.compile(r"(?:\+|-only|-or-later)$")
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd", "isc", "bsl-1.0", "unlicense", "cc0-1.0", "cc-by-4.0", "zlib", "0bsd", "mit-0", "ncsa", "x11"})
#: Weights of the score: an expression that parses, a notice with a grant, a bare phrase.
SCORE_EXPRESSION, SCORE_GRANT, SCORE_PHRASE = 1.0, 0.9, 0.6

_KEEP = bytes(c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_BINDS = {"or": 1, "and": 2, "with": 3}


def text_words(text: str) -> list[str]:
    return text.encode("utf-8", "replace").translate(_KEEP).decode("utf-8", "replace").split(" ")


def _label(piece: str) -> str | None:
    """The one spelling of a known identifier; None if it is not known."""
    name = _VERSION_SUFFIX.sub("", piece)
    return name if name in IDENTIFIERS or _REFERENCE.fullmatch(piece) else None


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order (shunting-yard), in lower case; None if it is malformed or names what is not known."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the last piece ended an operand
    before = ""
    expression = expression.lower().rstrip(" \t")
    end = next((len(e) for e in COMMENT_ENDS if expression.endswith(e)), 0)
    for found in _PIECE.finditer(expression[: len(expression) - end].rstrip(" \t")):
        piece = found[1]
        if piece == "(":
            if operand or before == "with":
                return None
            waiting.append(piece)
        elif piece == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif piece in _BINDS:
            if not operand or (piece == "with" and before == ")"):
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[piece]:
                out.append(waiting.pop())
            waiting.append(piece)
            operand = False
        else:
            if operand or (piece not in EXCEPTIONS if before == "with" else _label(piece) is None):
                return None
            out.append(piece)
            operand = True
        before = piece
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str, allowed: frozenset[str] = PERMISSIVE) -> tuple[list[str], bool] | None:
    """Identifiers of an expression, in one spelling, and whether it can be met with ``allowed`` licences alone."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[bool] = []
    names = []
    for piece in order:
        if piece in EXCEPTIONS:  # what it adds is no licence
            continue
        if piece not in _BINDS:
            names.append(_label(piece))
            stack.append(names[-1] in allowed)
        elif piece != "with":
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if piece == "or" else left and right)
    return names, stack[0]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    phrases = [(p, "base", label) for p, label in BASE] + [(p, "notice", label) for p, label in (*NOTICES, *VERSIONED)]
    phrases += [(p, "grant", "") for p in GRANTS] + [(TAG, "tag", "")]
    for phrase, kind, label in phrases:
        machine.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    machine.make_automaton()
    return machine


def scan_text(text: str) -> dict:
    """All findings in one text."""
    words = [w for w in text_words(text) if w]
    line = f" {' '.join(words)} "
    places: list[int] = []
    base, notices, seen, counted, granted, tagged = set(), {}, 0, 0, False, False
    for end, (kind, label, length) in _automaton().iter(line):
        begin = end - length + 1
        if kind == "base":
            base.add(label)
            if begin < seen:
                seen = counted = 0
            counted, seen = counted + line.count(" ", seen, begin), begin
            places.append(counted)
        elif kind == "notice":
            if begin not in notices or notices[begin][0] < length:
                notices[begin] = (length, label)
        elif kind == "grant":
            granted = True
        else:
            tagged = True
    parsed = [e for e in map(evaluate, _TAGGED.findall(text)) if e] if tagged else []
    labels = base | {label for _, label in notices.values()} | {name for names, _ in parsed for name in names}
    score = SCORE_EXPRESSION if parsed else SCORE_GRANT if granted and labels else SCORE_PHRASE if labels else 0.0
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score,
        "permissive": all(p for _, p in parsed) if parsed else None,
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the findings of each row of ``docs``.

    Null text counts as empty: no words, no labels, score 0.  ``permissive`` is null without an
    expression.  Of two notices that begin at one word the longer counts; the score is that of the strongest
    finding.  Each repeated row is scanned for itself.  Columns other than id and text are ignored.
    """
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    kinds += [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(text.as_py()) for text in batch.column("text")]
            out = [pa.array([f[name] for f in found], kind) for name, kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], ["doc_id", *[name for name, _ in kinds]])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return shipped(docs.select("doc_id", text_or_empty().alias("text"))).mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")

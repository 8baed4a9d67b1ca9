"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates the
and/or/with expression behind each tag.

Defined results: null or empty text: no words, no places, empty labels, score 0. Repeated rows give repeated results. An
empty table gives an empty one. Other columns of the input are not read. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from faultline.llm import common

#: The phrases whose places are counted.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of this scan.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission is hereby granted free of charge": "mit",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
}
#: How freely text under a licence may be reused, from 0 to 1.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "cc0": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc-by": 0.9,
    "mpl": 0.6, "cc-by-sa": 0.5, "lgpl": 0.5, "gpl": 0.2, "agpl": 0.1, "cc-by-nd": 0.1, "cc-by-nc": 0.1, "proprietary": 0.0,
}
UNKNOWN_FREEDOM = 0.3
#: What an exception behind `with` adds at least.
EXCEPTION_FREEDOM = 0.5
TAG = b"spdx-license-identifier:"
TAG_WORDS = "spdx license identifier"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, tags array<struct<expression: string, labels: array<string>, freedom: double>>"
)
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDING = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of a licence identifier: `GPL-2.0-only` is gpl, `CC-BY-NC-4.0` is cc-by-nc, an unknown one is itself."""
    name = identifier.lower().rstrip("+")
    known = [f for f in FREEDOM if name == f or name.startswith(f"{f}-")]
    return max(known, key=len) if known else name


def well_formed(text: bytes, at: int, end: int) -> list[str]:
    """The tokens of the longest well-formed expression that begins at a place."""
    tokens: list[str] = []
    good, depth, operand_next = 0, 0, True
    while m := _TOKEN.match(text, at, end):
        token, at = m[1].decode(), m.end()
        if operand_next:
            if token == "(":
                depth += 1
            elif token == ")" or token.lower() in _BINDING:
                break
            else:
                operand_next = False
        elif token == ")" and depth:
            depth -= 1
        elif token.lower() in _BINDING:
            operand_next = True
        else:
            break
        tokens.append(token)
        if not operand_next and not depth:
            good = len(tokens)
    return tokens[:good]


def postfix(text: str) -> list[str]:
    """Shunting-yard over the longest well-formed start of a text; operators come out in lower case after their operands."""
    raw = text.encode()
    return reordered(well_formed(raw, 0, len(raw)))


def reordered(tokens: list[str]) -> list[str]:
    out: list[str] = []
    stack: list[str] = []
    for token in tokens:
        low = token.lower()
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _BINDING:
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[low]:
                out.append(stack.pop())
            stack.append(low)
        else:
            out.append(token)
    return [*out, *reversed(stack)]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """(labels, freedom) of a postfix expression: `and` takes the stricter side, `or` the freer one, `with` an exception."""
    stack: list[tuple[set[str], float]] = []
    for token in tokens:
        if token in _BINDING and len(stack) >= 2:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, max(a, EXCEPTION_FREEDOM)))
            else:
                stack.append((left | right, min(a, b) if token == "and" else max(a, b)))
        else:
            label = family(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN_FREEDOM)))
    return stack[-1] if stack else (set(), 0.0)


def automaton() -> ahocorasick.Automaton:
    """All phrases between single spaces, and the words of a tag."""
    out = ahocorasick.Automaton()
    for phrase in {**NOTICE_PHRASES, **BASE_PHRASES, TAG_WORDS: ""}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def tags(raw: bytes) -> list[dict]:
    """The expressions behind identifier tags, each to the end of its line."""
    low, found, at, end = raw.lower(), [], 0, -1
    while (at := low.find(TAG, at)) >= 0:
        at += len(TAG)
        if end < at:
            end = low.find(b"\n", at)
            end = end if end >= 0 else len(raw)
        tokens = reordered(well_formed(raw, at, end))
        if tokens:
            labels, freedom = evaluate(tokens)
            found.append({"expression": " ".join(tokens), "labels": sorted(labels), "freedom": freedom})
    return found


def scan_text(raw: bytes, machine: ahocorasick.Automaton) -> dict:
    words = raw.translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    tagged = False
    gaps, seen = 0, 0  # spaces up to the end of the last place
    for end, phrase in machine.iter(line):
        if phrase in BASE_PHRASES:
            gaps, seen = gaps + line.count(" ", seen, end + 1), end + 1
            starts.append(gaps - 2 - phrase.count(" "))
            base.add(BASE_PHRASES[phrase])
        elif phrase == TAG_WORDS:
            tagged = True
        else:
            labels.add(NOTICE_PHRASES[phrase])
    found = tags(raw) if tagged else []
    values = [FREEDOM[x] for x in base | labels] + [x["freedom"] for x in found]
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels | {y for x in found for y in x["labels"]})),
        "score": min(values, default=0.0),
        "tags": found,
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels, the evaluated tags, and as score the least freedom of all evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for part in common.slices(batches):
            rows = [scan_text(raw, machine) for raw in common.raw_bytes(part.column("text"))]
            ids = part.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pylist([{"doc_id": i, **r} for i, r in zip(ids, rows, strict=True)], schema=ARROW)

    return common.texts(docs).mapInArrow(run, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("tags", pa.list_(pa.struct([("expression", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64())]))),
    ]
)


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(common.read(spark, folder, "documents")).drop("tags")

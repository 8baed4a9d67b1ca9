"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text gets one space in front, spaces become the marker U+2581, and the best sequence of pieces is the one with the greatest
sum of log scores. A character in no piece costs more than any piece and is written as byte pieces. Decoding joins the pieces'
bytes, turns markers into spaces and drops the one in front, so every text comes back exactly; a marker that stands in the text
itself goes through byte pieces for that reason.

No piece runs from another character into a marker, nor over a line feed, so a text falls into parts (spaces and a word, or a
line feed) whose best sequences don't depend on each other. Each distinct part of a task is searched once, all at the same time.

A file whose scores are whole numbers holds merge ranks and no probabilities; log scores are then those of Zipf's law, 1 / (rank + 1) over its sum.

Defined results: a null or empty text has no pieces and decodes to an empty one. Repeated rows give repeated results. An empty
table gives an empty one. `encode` passes all input columns on; its own are named by parameters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from faultline.llm import common

MARKER = "▁"
#: Stands for a marker in the text itself; no UTF-8 text has this byte.
LITERAL = b"\xff"
#: Below the least score, for a character in no piece.
UNKNOWN_PENALTY = 10.0
#: Parts that a task remembers before it starts anew.
REMEMBERED = 400_000
_PART = re.compile(rb" *[^ \n]+|\n| +")


@dataclass
class Trie:
    """Double-array trie: from state s, byte c leads to t = base[s] + c if check[t] == s. value[t] is a piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, pieces: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                found = children[node].get(c)
                if found is None:
                    found = children[node][c] = len(children)
                    children.append({})
                    ids.append(-1)
                node = found
            ids[node] = i
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        place = {0: 0}
        free, tail = 256, 256  # never below a byte: the first free place, for single children; and where several find room
        for node in range(len(children)):  # parents come before children
            kids = sorted(children[node].items())
            if not kids:
                continue
            while check[free] >= 0:
                free += 1
            b = max((free if len(kids) == 1 else max(free, tail)) - kids[0][0], 1)
            while True:
                if b + 256 >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[b + c] < 0 for c, _ in kids):
                    break
                b += 1
            tail = max(tail, b + kids[0][0] - 1024) if len(kids) > 1 else tail
            state = place[node]
            base[state] = b
            for c, kid in kids:
                check[b + c] = state
                value[b + c] = ids[kid]
                place[kid] = b + c
        arrays = [np.array(x, np.int32) for x in (base, check, value)]
        return cls(*[np.append(x, np.full(256, fill, np.int32)) for x, fill in zip(arrays, (0, -1, -1), strict=True)])


@dataclass
class Vocabulary:
    """What a piece file says, as arrays that are sent to the tasks; their size is that of the vocabulary."""

    trie: Trie
    score: np.ndarray  # log score by id
    unknown: float
    byte_id: np.ndarray  # id of each byte's piece
    text: np.ndarray  # bytes of all pieces, markers as spaces
    begin: np.ndarray  # where each id's bytes begin, and the end
    is_byte: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        score = np.array([model.get_score(i) for i in range(n)])
        names = [model.id_to_piece(i) for i in range(n)]
        is_byte = np.array([model.is_byte(i) for i in range(n)])
        normal = [i for i in range(n) if not (is_byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls.make(names, score, is_byte, normal)

    @classmethod
    def make(cls, names: list[str], score: np.ndarray, is_byte: np.ndarray, normal: list[int]) -> Vocabulary:
        byte_id = np.full(256, -1)
        for i in np.flatnonzero(is_byte):
            byte_id[int(names[i][3:5], 16)] = i
        if (byte_id < 0).any():
            raise ValueError("byte fallback needs a piece for every byte")
        if any("\n" in names[i] or re.search(f"[^{MARKER}]{MARKER}", names[i]) for i in normal):
            raise ValueError("pieces run over a line feed or from another character into a marker")
        score = zipf(score, normal)
        texts = [b"" for _ in names]
        for i in normal:
            texts[i] = names[i].replace(MARKER, " ").encode()
        for c, i in enumerate(byte_id):
            texts[i] = bytes([c])
        trie = Trie.build({names[i].replace(MARKER, " ").encode(): i for i in normal})
        begin = np.cumsum([0, *map(len, texts)])
        unknown = float(score[normal].min()) - UNKNOWN_PENALTY
        return cls(trie, score, unknown, byte_id, np.frombuffer(b"".join(texts), np.uint8), begin, is_byte)


def zipf(score: np.ndarray, normal: list[int]) -> np.ndarray:
    """Log scores: the given ones, or if these are merge ranks, those of Zipf's law."""
    given = score[normal]
    if len(given) and (given == np.round(given)).all():
        score = score.copy()
        rank = np.empty(len(given))
        rank[np.argsort(-given, kind="stable")] = np.arange(len(given))
        score[normal] = -np.log(rank + 1.0) - np.log((1.0 / (rank + 1.0)).sum())  # they sum to one
    return score


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def best_pieces(parts: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): best pieces of each part one after another, and where each part's end."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.cumsum(size) - size
    rel = np.arange(n) - np.repeat(first, size)
    left = np.repeat(first + size, size) - np.arange(n)  # bytes to the part's end
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(starts, n))
    edges = []
    at, state, length = starts, np.zeros(len(starts), np.int64), 0
    single = np.zeros(len(starts), bool)
    which = np.arange(len(starts))
    while len(at):
        inside = left[at] > length
        at, state, which = at[inside], state[inside], which[inside]
        to = v.trie.base[state].astype(np.int64) + data[at + length]
        ok = v.trie.check[to] == state
        at, state, which = at[ok], to[ok], which[ok]
        length += 1
        piece = v.trie.value[state]
        hit = piece >= 0
        edges.append((at[hit], np.full(int(hit.sum()), length), piece[hit].astype(np.int64)))
        single[which[hit & (width[which] == length)]] = True
    lone = starts[~single]
    edges.append((lone, width[~single], np.full(len(lone), -1)))
    begin, length, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
    gain = np.where(piece >= 0, v.score[piece], v.unknown)
    end = begin + length  # the place behind; the part's own end stands at its last byte + 1
    order = np.lexsort((begin, end, rel[end - 1]))
    begin, end, piece, gain = begin[order], end[order], piece[order], gain[order]
    level = rel[end - 1]
    cuts = np.flatnonzero(np.diff(level, prepend=-1))
    cuts = np.append(cuts, len(level))
    best = np.zeros(n + len(parts) + 1)  # one place more for each part, so that ends and starts don't meet
    part_of = np.repeat(np.arange(len(parts)), size)
    shift = part_of[begin]
    came = np.zeros(n + len(parts) + 1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        total = best[begin[a:b] + shift[a:b]] + gain[a:b]
        target = end[a:b] + shift[a:b]
        heads = np.flatnonzero(np.diff(target, prepend=-1))
        top = np.maximum.reduceat(total, heads)
        good = np.flatnonzero(total == np.repeat(top, np.diff(np.append(heads, b - a))))
        keep = good[np.flatnonzero(np.diff(target[good], prepend=-1))]  # ties: the longest piece
        best[target[keep]] = total[keep]
        came[target[keep]] = keep + a
    # walk back all parts at a time
    place = first + size
    owner = np.arange(len(parts))
    steps = []
    while True:
        open_ = place > first[owner]
        owner, place = owner[open_], place[open_]
        if not len(owner):
            break
        edge = came[place + owner]
        steps.append((owner, edge))
        place = begin[edge]
    owner = np.concatenate([s[0] for s in steps][::-1]) if steps else np.zeros(0, np.int64)
    edge = np.concatenate([s[1] for s in steps][::-1]) if steps else np.zeros(0, np.int64)
    order = np.lexsort((begin[edge], owner))
    owner, edge = owner[order], edge[order]
    # an unknown character becomes the pieces of its bytes, a literal marker those of the marker
    known = piece[edge] >= 0
    literal = ~known & (data[begin[edge]] == LITERAL[0])
    count = np.where(known, 1, np.where(literal, len(MARKER.encode()), end[edge] - begin[edge]))
    ids = np.zeros(int(count.sum()), np.int32)
    out_at = np.cumsum(count) - count
    ids[out_at[known]] = piece[edge[known]]
    plain = ~known & ~literal
    ids[ragged(out_at[plain], count[plain])] = v.byte_id[data[ragged(begin[edge[plain]], count[plain])]]
    if literal.any():
        ids[ragged(out_at[literal], count[literal])] = np.tile(v.byte_id[list(MARKER.encode())], int(literal.sum()))
    return ids, np.cumsum(np.bincount(owner, weights=count, minlength=len(parts)).astype(np.int64))


class Encoder:
    """Encodes texts with the best pieces of all parts met so far at hand."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): all ids one after another, and how many each text has."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number = self.number
        parts: list[int] = []
        sizes = []
        new: list[bytes] = []
        for raw in rows:
            if not raw:
                sizes.append(0)
                continue
            found = _PART.findall(b" " + raw.replace(MARKER.encode(), LITERAL))
            for part in found:
                at = number.get(part)
                if at is None:
                    at = number[part] = len(number)
                    new.append(part)
                parts.append(at)
            sizes.append(len(found))
        if new:
            ids, ends = best_pieces(new, self.v)
            self.begin = np.append(self.begin, ends + len(self.ids))
            self.ids = np.append(self.ids, ids)
        code = np.array(parts, np.int64)
        begin, size = self.begin[code], self.begin[code + 1] - self.begin[code]
        sums = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum([0, *sizes])
        return self.ids[ragged(begin, size)], np.diff(sums[ends])


def decode(ids: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The texts of ids that stand one after another."""
    width = v.begin[ids + 1] - v.begin[ids]
    data = v.text[ragged(v.begin[ids], width)].tobytes()
    sums = np.concatenate([[0], np.cumsum(width)])
    ends = sums[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [data[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]  # without the space in front


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, ids_column: str = "piece_ids", flag: str = "decodes") -> DataFrame:
    """The documents with the ids of their pieces, and whether these decode to the text (a null text decodes to an empty one);
    columns of these names are replaced."""
    v = Vocabulary.load(path or default_path())
    rows = docs.select(*[common.quoted(c) for c in docs.columns if c not in (ids_column, flag)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for part in common.slices(batches):
            raws = common.raw_bytes(part.column("text"))
            ids, sizes = encoder.encode(raws)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(ids))
            same = pa.array([a == b for a, b in zip(raws, decode(ids, sizes, v), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*part.columns, lists, same], names=[*part.schema.names, ids_column, flag])

    return common.map_whole(rows, run, {"text"}, f"`{ids_column}` array<int>, `{flag}` boolean")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Of each document: n_pieces, n_byte_pieces, crc32 of the ids (little-endian, 32 bits) and whether decoding gives the text."""
    v = Vocabulary.load(path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for part in common.slices(batches):
            raws = common.raw_bytes(part.column("text"))
            ids, sizes = encoder.encode(raws)
            texts = decode(ids, sizes, v)
            ends = np.cumsum([0, *sizes])
            bytes_ = np.concatenate([[0], np.cumsum(v.is_byte[ids])])[ends]
            flat = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            same = [a == b for a, b in zip(raws, texts, strict=True)]
            columns = [sizes.astype(np.int64), np.diff(bytes_).astype(np.int64), np.array(crc, np.int64), np.array(same, bool)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "same"]
            )

    return common.texts(docs).mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, same boolean")


def op5_unigram_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(common.read(spark, folder, "documents"))

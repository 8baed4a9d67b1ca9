"""Token ids in bit planes.

Texts are encoded in ascending doc_id order, an end id after each, and dealt into shards by ranges of doc_id. A shard's ids are
cut into blocks of fixed size. A block is transposed: plane b holds bit (or byte) b of all its ids, and each plane is compressed
by itself with zstandard. The table has a row per block; its chunk index says which ids the block holds, how long each plane is,
and which documents lie in it, wholly or in part. It is a Parquet table, so that any shared store takes it and lost tasks are written anew.

Defined results: a null or empty text is the end id alone. Repeated rows are written repeatedly, ties ordered by text hash; rows
without id come first. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.llm.pieces import ragged

BLOCK_IDS = 1 << 16
END_ID = 1
LEVEL = 3
#: Words that a worker process remembers with their ids, from task to task, before it starts anew.
REMEMBERED = 600_000
BLOCKS = (
    "shard int, block long, first long, n_ids long, bits int, planes array<int>, payload binary, "
    "docs array<struct<doc_id: long, start: long, n_tokens: long>>"
)
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))


def pack(ids: np.ndarray, bits: int, step: int = 1) -> tuple[list[int], bytes]:
    """(length of each compressed plane, the planes one after another). step: 1 for bit planes, 8 for byte planes."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    matrix = ids.astype(f"<u{bits // 8}").view(np.uint8).reshape(len(ids), bits // 8)  # a row per id
    if step == 1:
        matrix = np.unpackbits(matrix, axis=1, bitorder="little")
    matrix = np.ascontiguousarray(matrix.T)  # a row per plane
    planes = [squeeze(p.tobytes()) for p in (np.packbits(matrix, axis=1) if step == 1 else matrix)]
    return [len(p) for p in planes], b"".join(planes)


def unpack(lengths: list[int], payload: bytes, n_ids: int, bits: int) -> tuple[np.ndarray, int]:
    """(ids of a block, bits of a plane)."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    ends, step = np.cumsum(lengths).tolist(), bits // len(lengths)
    planes = np.stack([np.frombuffer(expand(payload[e - n : e]), np.uint8) for e, n in zip(ends, lengths, strict=True)])
    if step == 1:
        planes = np.unpackbits(planes, axis=1, count=n_ids)
    rows = np.ascontiguousarray(planes.T)
    if step == 1:
        rows = np.packbits(rows, axis=1, bitorder="little")
    return rows.view(f"<u{bits // 8}").ravel().astype(np.uint32), step


class WordIds:
    """Ids of whole texts.

    Where the tokenizer drops white space and never joins what it separates, a text's ids are those of its words one after
    another, and each distinct word is encoded once. Other tokenizers encode the texts themselves.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = 16 if self.tokenizer.get_vocab_size() <= 1 << 16 else 32
        plan = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (plan["normalizer"] or {}).get("normalizers", [])]
        split = ((plan["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        added = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in plan["added_tokens"])
        self.by_word = (
            split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
            and not re.search(r"\\s(?![^\[]*\])", split["pattern"].get("Regex", r"\s"))  # white space is only ruled out
            and normal == ["NFC", "Replace", "Lowercase"] and not added
        )
        self.plain = self.by_word and split["pattern"].get("Regex") == common.CUT
        self.model = Tokenizer(self.tokenizer.model)  # without normalising and cutting
        self.forget()

    def forget(self) -> None:
        self.memory = common.Memory()
        self.ids, self.begin, self.seen = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def thin_out(self) -> None:
        """Keep the words that were seen again; if these are too many as well, start anew."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > REMEMBERED // 2:
            return self.forget()
        self.memory.keep(keep)
        size = self.begin[keep + 1] - self.begin[keep]
        self.ids = self.ids[ragged(self.begin[keep], size)]
        self.begin, self.seen = np.concatenate([[0], np.cumsum(size)]), np.ones(len(keep), np.int64)

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) as the library has them."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of words. Plain ones are cut here as the tokenizer cuts them, and its model gets all their
        parts in one call; the others take the way of whole texts."""
        is_plain = np.array([self.plain and common.PLAIN_WORD.fullmatch(w.decode()) is not None for w in words], bool)
        sizes = np.zeros(len(words), np.int64)
        plain, other = list(compress(words, is_plain)), list(compress(words, ~is_plain))
        ids = np.zeros(0, np.uint32)
        if plain:
            cut = common.PARTS.findall(b" ".join(plain).decode().lower())
            gap = np.fromiter((p == " " for p in cut), bool, len(cut))
            parts = common.as_bytes("\n".join(cut)).split(common.as_bytes("\n"))
            encoding = self.model.encode(list(compress(parts, ~gap)), is_pretokenized=True, add_special_tokens=False)
            word = np.cumsum(gap)[~gap][np.array(encoding.word_ids, np.int64)]
            ids, sizes[is_plain] = np.array(encoding.ids, np.uint32), np.bincount(word, minlength=len(plain))
        if other:
            more, sizes[~is_plain] = self.found(other)
            ids = np.append(ids, more)
        place = np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])  # of each run of ids
        begin = np.zeros(len(words), np.int64)
        begin[place] = np.cumsum(sizes[place]) - sizes[place]
        return ids[ragged(begin, sizes)], sizes

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes), the end id behind each text."""
        if not self.by_word:
            ids, sizes = self.found(rows)
            return np.insert(ids, np.cumsum(sizes), END_ID), sizes + 1
        if len(self.memory) > REMEMBERED:
            self.thin_out()
        words = common.Words(rows)
        hashes, first, code = words.distinct()
        known = self.memory.find(words, hashes, first)
        new = np.flatnonzero(known < 0)
        ids, sizes = self.of_words([words.word(k) for k in first[new].tolist()])
        known[new] = self.memory.add(words, hashes[new], first[new])
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))
        self.ids, self.seen = np.append(self.ids, ids), np.append(self.seen, np.zeros(len(new), np.int64))
        self.seen[known] += np.bincount(code, minlength=len(first))
        code = known[code]
        size = self.begin[code + 1] - self.begin[code]
        sums = np.concatenate([[0], np.cumsum(size)])
        ends = sums[words.first[1:]]  # behind each text's ids
        return np.insert(self.ids[ragged(self.begin[code], size)], ends, END_ID), np.diff(ends, prepend=0) + 1


_encoders: dict[str, WordIds] = {}


def encoder_of(path: str) -> WordIds:
    """The worker process's encoder."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def block_row(shard: int, block: int, first: int, ids: np.ndarray, bits: int, step: int, docs: list[tuple]) -> pa.RecordBatch:
    lengths, payload = pack(ids, bits, step)
    values = [[shard], [block], [first], [len(ids)], [bits], [lengths], [payload], [[dict(zip(("doc_id", "start", "n_tokens"), d)) for d in docs]]]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), _DOCS]
    names = ["shard", "block", "first", "n_ids", "bits", "planes", "payload", "docs"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def write_blocks(docs: DataFrame, path: str | None = None, step: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode documents and write the block table; `first` and `start` count from the begin of the shard."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), encoder_of(path)
        held, block, first, starting, total = np.zeros(0, np.uint32), 0, 0, [], 0
        for part in common.slices(batches):
            ids, sizes = encoder.encode(common.raw_bytes(part.column("text")))
            for doc_id, n in zip(part.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                starting.append((doc_id, total, n))
                total += n
            held = np.concatenate([held, ids])
            while len(held) >= block_ids:
                own = [d for d in starting if d[1] < first + block_ids]
                starting = [d for d in starting[len(own) - 1 :] if d[1] + d[2] > first + block_ids]  # the last may go on
                yield block_row(shard, block, first, held[:block_ids], encoder.bits, step, own)
                held, block, first = held[block_ids:], block + 1, first + block_ids
        if len(held):
            yield block_row(shard, block, first, held, encoder.bits, step, starting)

    rows = common.texts(docs).withColumn("_h", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    return common.store(rows.mapInArrow(run, BLOCKS), "blocks")


PIECES = "shard int, start long, doc_id long, n_tokens long, at long, ids_crc32 long, ids binary"
_PIECES = pa.schema(
    [
        ("shard", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int64()),
        ("ids_crc32", pa.int64()), ("ids", pa.binary()),
    ]
)


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the blocks alone; start counts from the begin of all ids.

    Blocks are read in any order. A document that lies in one block is done there; of the others, which meet at block borders,
    the pieces are brought together and summed in order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _ = unpack(row["planes"], row["payload"], row["n_ids"], row["bits"])
                flat, first = ids.astype("<u4").tobytes(), row["first"]
                out = []
                for d in row["docs"]:
                    a, b = max(d["start"] - first, 0), min(d["start"] + d["n_tokens"] - first, row["n_ids"])
                    piece = flat[4 * a : 4 * b]
                    whole = b - a == d["n_tokens"]
                    out.append(
                        {"shard": row["shard"], **d, "at": a + first, "ids_crc32": zlib.crc32(piece) if whole else None}
                        | {"ids": None if whole else piece}
                    )
                yield pa.RecordBatch.from_pylist(out, schema=_PIECES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # shard, start, id, tokens, tokens to come, crc
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or now[:2] != [r["shard"], r["start"]]:
                    now = [r["shard"], r["start"], r["doc_id"], r["n_tokens"], r["n_tokens"], 0]
                now[4] -= len(r["ids"]) // 4
                now[5] = zlib.crc32(r["ids"], now[5])
                if not now[4]:
                    done.append({"shard": now[0], "start": now[1], "doc_id": now[2], "n_tokens": now[3], "at": now[1], "ids_crc32": now[5], "ids": None})
            yield pa.RecordBatch.from_pylist(done, schema=_PIECES)

    pieces = common.store(blocks.mapInArrow(read, PIECES), "pieces")
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pieces.filter("ids is not null").repartition(n, "shard", "start").sortWithinPartitions("shard", "start", "at")
    found = pieces.filter("ids is null").unionByName(parts.mapInArrow(join, PIECES))
    # a row for each shard, of which there are as many as shuffle partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    sizes = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = found.join(F.broadcast(sizes), "shard")
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op1_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    return read_documents(write_blocks(common.read(spark, folder, "documents")))

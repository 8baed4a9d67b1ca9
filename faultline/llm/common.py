"""Shared helpers: input columns, bounded slices of Arrow batches, tables in the shared folder, vectorised word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a task turns into arrays at a time; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: ASCII white space: the gaps between words of `[^\x20\x09-\x0D]+`, which is also what bytes.split() cuts at.
GAPS = " \t\n\x0b\x0c\r"

# How the tokenizer of words cuts what lies between white space.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = r"\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
#: Words in which this only tells letters, single figures and signs apart: printable ASCII without apostrophes and "<", and Latin
#: letters that are composed and whose lower case is one letter.
PLAIN_WORD = re.compile(rf"[!-&(-;=-~{_LATIN}]+")
#: The parts of plain words in lower case, with spaces between the words.
PARTS = re.compile(rf"[a-z{_LATIN}]+|[0-9]| |[^a-z0-9 {_LATIN}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: printable ones for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


LETTERS = str.maketrans(dict(enumerate(byte_letters())))


def as_bytes(text: str) -> str:
    """A text with a vocabulary's letter for each of its UTF-8 bytes."""
    return text.encode().decode("latin-1").translate(LETTERS)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text of documents, whatever other columns there are; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def quoted(name: str) -> str:
    """A column's name as text that finds it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_whole(docs: DataFrame, run, known: set[str], more: str = "") -> DataFrame:
    """mapInArrow over rows with all their columns, of which `run` sees those in `known` by name and the others as _0, _1, ...;
    `more` adds columns in DDL. Columns may have any name, dots and quotes included."""
    names = docs.columns
    plain = docs.toDF(*[c if c in known and names.count(c) == 1 else f"_{k}" for k, c in enumerate(names)])
    schema = StructType([*plain.schema.fields, *(StructType.fromDDL(more).fields if more else [])])
    return plain.mapInArrow(run, schema).toDF(*names, *[f.name for f in schema.fields[len(names) :]])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Only local runs may pick their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there and a lost executor repeats nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about `limit` bytes of a string or binary column and at most `rows` rows, one row at least."""
    for batch in batches:
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + limit, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(values: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw_bytes(values: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null gives none."""
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts as arrays: which text, first and last byte, and a 64-bit hash of each word.

    A word's hash is a polynomial over its bytes modulo 2^64, taken from running sums over all bytes, then mixed with its
    length. No Python object is made for a word.
    """

    FACTOR = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(FACTOR, -1, 1 << 64)
    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, rows: list[bytes]):
        data = np.frombuffer(b"\n".join([*rows, b""]), np.uint8)  # a gap after each text
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
        self.start, self.end = edge[0::2], edge[1::2]
        self.texts = len(rows)
        self.begin = np.cumsum([0, *(len(r) + 1 for r in rows)])  # first byte of each text
        self.first = np.searchsorted(self.start, self.begin)  # first word of each text, and one end
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(self.texts), self.count)
        self.data = data

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each distinct word, a place of it, which of them each word is).

        Words are told apart by their hashes; then all their bytes are held against those of the word that stands for them."""
        size = self.end - self.start
        all_hashes = self.hashes()
        hashes, first, code = np.unique(all_hashes, return_index=True, return_inverse=True)
        same = same_bytes(self.data, self.start, size, self.data, self.start[first[code]], size[first[code]])
        if not same.all():  # words of one hash: those that differ from its first word stand for themselves
            odd = np.flatnonzero(~same)
            code[odd] = len(first) + np.arange(len(odd))
            hashes, first = np.append(hashes, all_hashes[odd]), np.append(first, odd)
        return hashes, first, code

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def hashes(self) -> np.ndarray:
        power, inverse = self.powers(len(self.data))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
            value = (sums[self.end] - sums[self.start]) * inverse[self.start]
            return mix(value ^ ((self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls._powers is None or len(cls._powers[0]) < n:
            grow = max(n, SLICE_BYTES + (1 << 17))
            with np.errstate(over="ignore"):
                made = []
                for base in (cls.FACTOR, cls.INVERSE):
                    steps = np.full(grow, base, np.uint64)
                    steps[0] = 1
                    made.append(np.cumprod(steps, dtype=np.uint64))
            if n > SLICE_BYTES + (1 << 17):  # for one very long text only, not kept
                return made[0][:n], made[1][:n]
            cls._powers = tuple(made)
        return cls._powers[0][:n], cls._powers[1][:n]


def same_bytes(
    data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, there: np.ndarray, other_size: np.ndarray
) -> np.ndarray:
    """Whether each run of bytes equals its counterpart."""
    same = size == other_size
    n = np.where(same, size, 0)
    ends = np.cumsum(n)
    letter = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
    unequal = np.flatnonzero(data[letter + np.repeat(start, n)] != other[letter + np.repeat(there, n)])
    same[np.searchsorted(ends, unequal, "right")] = False
    return same


class Memory:
    """Numbers of words that a worker has seen, found by their hashes and proved by their bytes."""

    def __init__(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.begin = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.begin) - 1

    def find(self, words: Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of each of the words at these places, -1 for words not seen."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.full(len(at), -1, np.int64)
        if not len(self.hashes):
            return out
        hit = np.flatnonzero(self.hashes[place] == hashes)
        number = self.numbers[place[hit]]
        start, size = words.start[at[hit]], words.end[at[hit]] - words.start[at[hit]]
        begin = self.begin[number]
        same = same_bytes(words.data, start, size, self.data, begin, self.begin[number + 1] - begin)
        out[hit[same]] = number[same]
        return out

    def add(self, words: Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number new words from the next free number on. A second word of a hash is numbered but never found again."""
        numbers = len(self) + np.arange(len(at))
        size = words.end[at] - words.start[at]
        ends = np.cumsum(size)
        letter = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        self.data = np.append(self.data, words.data[letter + np.repeat(words.start[at], size)])
        self.begin = np.append(self.begin, self.begin[-1] + ends)
        order = np.argsort(hashes, kind="stable")
        place = np.searchsorted(self.hashes, hashes[order], "right")
        self.hashes = np.insert(self.hashes, place, hashes[order])
        self.numbers = np.insert(self.numbers, place, numbers[order])
        return numbers

    def keep(self, some: np.ndarray) -> None:
        """Forget all but these numbers, in ascending order; they are numbered anew in that order."""
        new = np.full(len(self), -1, np.int64)
        new[some] = np.arange(len(some))
        stay = new[self.numbers] >= 0
        self.hashes, self.numbers = self.hashes[stay], new[self.numbers[stay]]
        size = self.begin[some + 1] - self.begin[some]
        ends = np.cumsum(size)
        letter = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        self.data, self.begin = self.data[letter + np.repeat(self.begin[some], size)], np.concatenate([[0], ends])


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of `width` words; a text with fewer words, but one at least, is one run by itself."""
    with np.errstate(over="ignore"):
        n, long = len(hashes), words.count >= width
        inside = np.zeros(n, bool)
        if n >= width:
            inside[: n - width + 1] = words.text[: n - width + 1] == words.text[width - 1 :]
        at = np.flatnonzero(inside)
        value = np.full(len(at), np.uint64(width))
        for i in range(width):
            value = mix(value * np.uint64(0x2545F4914F6CDD1D) + hashes[at + i])
        text = words.text[at]
        short = np.flatnonzero(~long & (words.count > 0))
        if len(short):
            extra = []
            for t in short:
                x = np.full(1, np.uint64(words.count[t]))
                for h in hashes[words.first[t] : words.first[t + 1]]:
                    x = mix(x * np.uint64(0x2545F4914F6CDD1D) + h)
                extra.append(x[0])
            text = np.concatenate([text, short])
            value = np.concatenate([value, np.array(extra, np.uint64)])
        return text, value


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs in order."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def long_or_null(condition: Column, value: Column) -> Column:
    return F.when(condition, value.cast("long"))

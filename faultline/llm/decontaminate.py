"""Benchmark decontamination: a BM25 inverted index of test items, searched with every passage by block-max WAND.

Each text is cut into passages that overlap by half and are twice as long as the longest item, so a copied item lies whole in
one of them. A passage is a query of its distinct words. An item's scores are divided by the score of the item itself, so one
threshold fits all items. The search is WAND over many passages at a time: the sum of each word's greatest impact rules out
passages, the sums of block maxima rule out blocks of items, and only items of the remaining blocks are scored. All three are
upper bounds, so every item at or above the threshold is found. A hit counts as a leak if enough word triples of the item's
question and of its answer stand in the passage. With `edited`, as in the query and the pipeline, it also does with most triples
of the whole item, and single words of an answer count if they stand close to one another: few changed words leave an answer of few
triples none of them.

Items are dealt into shards of bounded size; every shard is broadcast and searched with all passages in turn.

Defined results: null or empty texts and items have no words and give nothing. Repeated rows give repeated results; of items
with the same id, any may match; an item without id goes by the hash of its text. Empty tables give an empty result. Rows without id are searched like all others. Other columns
are not read by `leaks`; `drop_leaks` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common

K1, B = 1.2, 0.75
#: Least share of an item's own score.
THRESHOLD = 0.5
#: Least share of the word triples of question and of answer.
OVERLAP = 0.5
#: Least share of the word triples of a whole item, whatever its parts have.
WHOLE = 0.7
#: Answers with fewer triples also count by single words: two changed words leave half of so many triples.
FEW = 12
#: Words that may stand between those of an answer.
LOOSE = 2
GRAM = 3
#: Items of a block: fewer make tighter bounds, more make fewer of them.
BLOCK = 4
#: Items and text bytes of a shard, which bound what is broadcast.
SHARD_ITEMS = 2000
SHARD_BYTES = 4 << 20
LEAST_STRIDE = 64
BROADCAST_IDS = 500_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_hashes(rows: list[bytes]) -> tuple[common.Words, np.ndarray]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    words = common.Words([r.translate(_LETTERS) for r in rows])
    return words, words.hashes()


def grams(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashed word triples; of a shorter text its distinct words."""
    if len(hashes) < GRAM:
        return np.unique(hashes)
    with np.errstate(over="ignore"):
        value = np.full(len(hashes) - GRAM + 1, np.uint64(GRAM))
        for i in range(GRAM):
            value = common.mix(value * np.uint64(0x2545F4914F6CDD1D) + hashes[i : len(hashes) - GRAM + 1 + i])
    return np.unique(value)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last line is the answer; of a single line the last third of its words."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass
class Index:
    """Postings by block of items, with the greatest impact of each term, overall and by block."""

    ids: np.ndarray
    terms: np.ndarray  # sorted hashes
    greatest: np.ndarray  # by term
    block_max: np.ndarray  # term x block
    blocks: list[tuple[np.ndarray, np.ndarray]]  # of each block its terms and their impacts on its items
    question: list[np.ndarray]
    answer: list[np.ndarray]
    whole: list[np.ndarray]
    answer_words: list[np.ndarray]  # of answers with few triples, else none
    stride: int

    @classmethod
    def build(cls, items: list[tuple[int, str]], n_items: int, mean_length: float, df: dict[int, int]) -> Index:
        """df: in how many of all items, of this shard or not, each word hash stands."""
        words, hashes = word_hashes([t.encode() for _, t in items])
        terms = np.unique(hashes)
        idf = np.array([log(1 + (n_items - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in terms])
        n_blocks = -(-len(items) // BLOCK)
        block_max = np.zeros((len(terms), n_blocks), np.float32)
        blocks = []
        for k in range(n_blocks):
            cells = []
            for slot, i in enumerate(range(k * BLOCK, min((k + 1) * BLOCK, len(items)))):
                at, tf = np.unique(np.searchsorted(terms, hashes[words.first[i] : words.first[i + 1]]), return_counts=True)
                impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words.count[i] / mean_length))
                cells.append((slot, at, impact / impact.sum()))
            own = np.unique(np.concatenate([at for _, at, _ in cells]))
            table = np.zeros((len(own), BLOCK))
            for slot, at, impact in cells:
                table[np.searchsorted(own, at), slot] = impact
            blocks.append((own, table))
            # rounded up, so that they stay upper bounds
            block_max[own, k] = np.nextafter(table.max(axis=1).astype(np.float32), np.float32(2))
        parts = [question_and_answer(t) for _, t in items]
        sides = [[grams(word_hashes([p[side].encode()])[1]) for p in parts] for side in (0, 1)]
        whole = [grams(hashes[words.first[i] : words.first[i + 1]]) for i in range(len(items))]
        said = [word_hashes([answer.encode()])[1] for _, answer in parts]
        said = [w if len(a) < FEW else w[:0] for w, a in zip(said, sides[1], strict=True)]
        stride = max(LEAST_STRIDE, int(words.count.max()))
        return cls(np.array([i for i, _ in items]), terms, block_max.max(axis=1), block_max, blocks, *sides, whole, said, stride)

    def search(self, words: common.Words, hashes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, first word of the passage, item's place, score) of all items at or above the threshold."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == hashes)
        if not len(known):
            return []
        # half passages of `stride` words; passage p of a text holds its half passages p and p + 1
        half = (known - words.first[words.text[known]]) // self.stride
        halves = np.maximum(1, -(-words.count // self.stride))
        first = np.cumsum([0, *halves])  # first passage of each text
        passage = first[words.text[known]] + half
        before = half > 0
        pair = np.concatenate([passage, passage[before] - 1]) * np.int64(len(self.terms))
        pair = np.unique(pair + np.concatenate([at[known], at[known][before]]))
        passage, term = pair // len(self.terms), pair % len(self.terms)
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(starts[1:], len(passage))
        slack = THRESHOLD - 1e-6
        hopeful = np.flatnonzero(np.add.reduceat(self.greatest[term], starts) >= slack)
        out = []
        step = max(1, (1 << 22) // self.block_max.shape[1])  # rows of block maxima at a time
        group = 0
        while group < len(hopeful):
            size = np.cumsum(ends[hopeful[group:]] - starts[hopeful[group:]])
            stop = group + max(1, int(np.searchsorted(size, step, "right")))
            chosen = hopeful[group:stop]
            group = stop
            rows = np.concatenate([term[starts[p] : ends[p]] for p in chosen])
            cuts = np.cumsum([0, *(ends[chosen] - starts[chosen])[:-1]])
            bounds = np.add.reduceat(self.block_max[rows], cuts, axis=0)
            for p, k in zip(*np.nonzero(bounds >= slack), strict=True):
                own, table = self.blocks[k]
                mine = term[starts[chosen[p]] : ends[chosen[p]]]
                place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                scores = table[place[own[place] == mine]].sum(axis=0)
                number = int(passage[starts[chosen[p]]])
                text = int(np.searchsorted(first, number, "right")) - 1
                for slot in np.flatnonzero(scores >= THRESHOLD):
                    out.append((text, (number - int(first[text])) * self.stride, int(k) * BLOCK + int(slot), float(scores[slot])))
        return out


def overlap(wanted: np.ndarray, words: np.ndarray) -> float:
    """Share of an item's triples that stand in a passage."""
    if not len(wanted):
        return 1.0
    have = grams(words) if len(words) >= GRAM else words
    both = np.isin(wanted, have).sum()
    return float(max(both, np.isin(wanted, words).sum())) / len(wanted)


def close_overlap(answer: np.ndarray, words: np.ndarray) -> float:
    """The largest share of an answer's distinct words that stands in one stretch of a passage, LOOSE words longer than the answer."""
    wanted = np.unique(answer)
    if not len(wanted) or not len(words):
        return 0.0
    long = len(answer) + LOOSE
    found = np.zeros(len(words) + long, np.int64)  # by last word of a stretch
    for word in wanted:
        edge = np.zeros(len(found) + 1, np.int64)
        at = np.flatnonzero(words == word)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + long, -1)
        found += np.cumsum(edge)[: len(found)] > 0
    return float(found.max()) / len(wanted)


def scan(rows: list[bytes], index: Index, edited: bool = False) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item id, score, question overlap, answer overlap, first word) of each leak; of several passages the best."""
    words, hashes = word_hashes(rows)
    best: dict[tuple[int, int], tuple] = {}
    for text, start, item, score in index.search(words, hashes):
        begin = int(words.first[text]) + start
        passage = hashes[begin : min(begin + 2 * index.stride, int(words.first[text + 1]))]
        q, a = overlap(index.question[item], passage), overlap(index.answer[item], passage)
        if edited and q >= OVERLAP > a:
            a = max(a, close_overlap(index.answer_words[item], passage))
        if (q >= OVERLAP and a >= OVERLAP) or (edited and overlap(index.whole[item], passage) >= WHOLE):
            key = (text, int(index.ids[item]))
            best[key] = max(best.get(key, (0.0, 0.0, 0.0, 0)), (score, q, a, -start))
    return [(t, i, score, q, a, -start) for (t, i), (score, q, a, start) in sorted(best.items())]


def shards(items: DataFrame) -> Iterator[Index]:
    """Indexes of all items with words; words are counted over all of them first."""
    text = F.coalesce("text", F.lit(""))
    items = items.select(F.coalesce(F.col("item_id").cast("long"), F.xxhash64(text)).alias("item_id"), text.alias("text"))
    items = common.store(items, "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            words, hashes = word_hashes(common.raw_bytes(part.column("text")))
            text, value = common.distinct(words.text, hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(words.count[text].astype(np.int64)), pa.array(text == np.append(text[1:], -1))],
                names=["word", "length", "inner"],
            )

    words = common.store(items.mapInArrow(count, "word long, length long, inner boolean"), "words")
    # the last word of each item stands for the item
    n_items, total = words.filter("not inner").agg(F.count("*"), F.sum("length")).first()
    if not n_items:
        return
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n_shards = max(-(-items.count() // SHARD_ITEMS), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    for k in range(n_shards):
        part = items.filter(shard == k).orderBy("item_id", "text").collect()  # a shard is of bounded size
        part = [(r.item_id, r.text) for r in part if r.text.encode().translate(_LETTERS).split()]
        if part:
            _, own = word_hashes([t.encode() for _, t in part])
            own = [(int(x),) for x in np.unique(own).view(np.int64)]
            spark = items.sparkSession
            known = df.join(F.broadcast(spark.createDataFrame(own, "word long")), "word").collect() if n_shards > 1 else df.collect()
            yield Index.build(part, n_items, total / n_items, {r.word & (1 << 64) - 1: r.df for r in known})


SCHEMA = "doc_id long, text_key long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def leaks(docs: DataFrame, items: DataFrame, edited: bool = False) -> DataFrame:
    """One row per document row and benchmark item found in it."""
    rows = common.texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for index in shards(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for part in common.slices(batches):
                found = scan(common.raw_bytes(part.column("text")), index, edited)
                columns = list(zip(*found, strict=True)) or [[]] * 6
                text = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(text), part.column("text_key").take(text), pa.array(columns[1], pa.int64())]
                    + [pa.array(c, pa.float64()) for c in columns[2:5]]
                    + [pa.array(columns[5], pa.int64())],
                    names=["doc_id", "text_key", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                )

        out = out.union(rows.mapInArrow(run, SCHEMA))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, edited: bool = False) -> DataFrame:
    """The rows of documents without a leak, with all their columns."""
    found = leaks(docs, items, edited).select(F.col("doc_id").cast("long").alias("_id"), F.col("text_key").alias("_key")).distinct()
    found = common.store(found, "leaks")
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_key"])
    return docs.join(found, same, "left_anti")


def op9_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(common.read(spark, folder, "documents"), common.read(spark, folder, "benchmark"), edited=True).drop("text_key")

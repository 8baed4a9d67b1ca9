"""Exact token counts of every prefix of every text.

A token's place in byte pairs' merging depends on what follows it only through the tokens next to it. So the tokens of a prefix
are those of a shorter prefix and one token more: the one that ends the prefix and that merging would leave apart from the last token
before it. A table over prefixes holds the last token and the number of tokens, once for prefixes that go on (no mark on the
last symbol) and once for prefixes that end a word (with the mark). Words are counted once per worker, and those that share a
beginning share its part of the table.

The result is a stored table: for each text the change of the count at each code point, compressed. From it the count at any
prefix, and the longest prefix within a budget, are read without encoding anything again.

Defined results: a null or empty text has no prefix and no tokens. Repeated rows are rows of their own; a null id stays null. An
empty table gives an empty one. Other columns are not read. Counts may fall as a prefix grows, when its last tokens merge: the longest
prefix within a budget is the last one whose count fits.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.llm.pieces import ragged

LIMIT = 2048
#: Words whose counts a worker process keeps before it starts anew.
REMEMBERED = 400_000
#: Bytes up to which prefixes are kept for other words.
SHARED = 6
_NEVER = 1 << 60
#: The white space of Unicode, as the tokenizers library has it.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Merges:
    """Merging of byte pairs with a mark on each word's last symbol, as tables over prefixes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], mark: str):
        self.rank: dict[tuple[int, int], int] = {}
        self.born, self.left, self.right = ([-1] * len(vocab) for _ in range(3))
        for k, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if self.born[made] >= 0:
                raise ValueError("a token that two merges make")
            self.rank[x, y] = k
            self.born[made], self.left[made], self.right[made] = k, x, y
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(mark)}
        self.final = {t[: -len(mark)]: i for t, i in vocab.items() if t.endswith(mark)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.known: dict[tuple[int, int], bool] = {}
        self.shared: dict[str | None, tuple[int, int, int]] = {}  # what is known of short prefixes
        self.text, self.last, self.count, self.ended = "", [0], [0], [0]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between these tokens alone.

        Goes back in time from the finished tokens: the one made later falls into its parts, and of the pieces that touch the
        border at a time none may have been merged before either went into something else; of equal ranks the left one comes first.
        """
        asked = (a, b)
        found = self.known.get(asked)
        if found is None:
            until_a = until_b = _NEVER
            while True:
                k = self.rank.get((a, b), _NEVER)
                if k < until_a and k <= until_b and k != _NEVER:
                    found = False
                    break
                if self.born[a] < 0 and self.born[b] < 0:
                    found = True
                    break
                if self.born[b] >= self.born[a]:
                    until_b, b = self.born[b], self.left[b]
                else:
                    until_a, a = self.born[a], self.right[a]
            if len(self.known) > 2_000_000:
                self.known.clear()
            self.known[asked] = found
        return found

    def prefixes(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ... as words of their own; asked in order, words share their common beginning."""
        old, n = self.text, len(word)
        keep = len(os.path.commonprefix([old, word])) if not word.startswith(old) else len(old)
        last, count, ended = self.last, self.count, self.ended
        del last[keep + 1 :], count[keep + 1 :], ended[keep + 1 :]
        inner, final, apart, longest, shared = self.inner, self.final, self.apart, self.longest, self.shared
        for j in range(keep + 1, n + 1):
            start = word[:j] if j <= SHARED else None
            state = shared.get(start)
            if state is None:
                # only one length of the last token fits, so the shortest are tried first
                for i in range(j - 1, max(-1, j - longest - 1), -1):
                    token = inner.get(word[i:j])
                    if token is not None and (not i or apart(last[i], token)):
                        break
                for k in range(j - 1, max(-1, j - longest - 1), -1):
                    ending = final.get(word[k:j])
                    if ending is not None and (not k or apart(last[k], ending)):
                        break
                state = token, count[i] + 1, count[k] + 1
                if start:
                    shared[start] = state
            last.append(state[0])
            count.append(state[1])
            ended.append(state[2])
        self.text = word
        return ended[1:]


class PrefixCounts:
    """Counts for one tokenizer file: byte pairs with a mark at the end of words, lower case, white space dropped.

    Other kinds of tokenizer are refused: their counts do not add up over words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        model, parts = plan["model"], [x["type"] for x in (plan["normalizer"] or {}).get("normalizers", [])]
        split = ((plan["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or parts != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed":
            raise ValueError(f"not a tokenizer of words: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.plain = split["pattern"]["Regex"] == common.CUT
        special = sorted((t["content"] for t in plan["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.forget()

    def forget(self) -> None:
        self.memory = common.Memory()
        self.deltas, self.begin = np.zeros(0, np.int16), np.zeros(1, np.int64)
        self.total, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.part: dict[str, list[int]] = {}
        self.merges.shared.clear()

    def thin_out(self) -> None:
        """Keep the words that were seen again; if these are too many as well, start anew."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > REMEMBERED // 2:
            return self.forget()
        self.memory.keep(keep)
        size = self.begin[keep + 1] - self.begin[keep]
        self.deltas = self.deltas[ragged(self.begin[keep], size)]
        self.begin = np.concatenate([[0], np.cumsum(size)])
        self.total, self.seen = self.total[keep], np.ones(len(keep), np.int64)

    # --- words ---

    def of_part(self, part: str) -> list[int]:
        """Counts at each code point of a part that is never split when it grows."""
        found = self.part.get(part)
        if found is None:
            raw = part.encode()
            ended = self.merges.prefixes(common.as_bytes(part))
            if len(raw) != len(part):
                ends = np.flatnonzero((np.frombuffer(raw + b"a", np.uint8) & 0xC0) != 0x80)[1:] - 1
                ended = [ended[e] for e in ends.tolist()]
            found = self.part[part] = ended
        return found

    def of_normal(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(counts at each code point, first code points of the parts, counts before the parts) of a normalised text."""
        counts, starts, before, base = [], [], [], 0
        for found in self.pattern.finditer(text):
            counts += [base] * (found.start() - len(counts))
            part = found[0]
            if part[0] == "'" and len(part) > 1 and part[1].isalpha():  # such as 've: its prefixes split otherwise
                own = [sum(self.of_part(p)[-1] for p in self.pattern.findall(part[:k])) for k in range(1, len(part))]
                own.append(self.of_part(part)[-1])
            else:
                own = self.of_part(part)
            starts.append(found.start())
            before.append(base)
            counts += [base + c for c in own]
            base += own[-1]
        return counts + [base] * (len(text) - len(counts)), starts, before

    def of_region(self, text: str) -> list[int]:
        """Counts at each code point of a text without special tokens."""
        lower = lambda t: "".join(map(str.lower, t))  # noqa: E731  each by itself
        if unicodedata.is_normalized("NFC", text):
            low = text.lower()
            if len(low) == len(text) and "Σ" not in text:
                return self.of_normal(low)[0]
            clusters, sizes = list(text), [1] * len(text)
        else:
            firsts = [i for i, c in enumerate(text) if not i or starts_anew(c)]
            clusters = [text[a:b] for a, b in zip(firsts, [*firsts[1:], len(text)], strict=True)]
            sizes = list(map(len, clusters))
        normal = [lower(unicodedata.normalize("NFC", c)) for c in clusters]
        whole = "".join(normal)
        counts, starts, before = self.of_normal(whole)
        out, at = [], 0
        for cluster, size, made in zip(clusters, sizes, normal, strict=True):
            for k in range(1, size):  # a prefix that ends within a cluster may be composed otherwise
                p = max(bisect_right(starts, max(at - 3, 0)) - 1, 0)
                start, base = (starts[p], before[p]) if starts and starts[p] <= at else (0, 0)
                tail = whole[start:at] + lower(unicodedata.normalize("NFC", cluster[:k]))
                out.append(base + self.of_normal(tail)[0][-1])
            at += len(made)
            out.append(counts[at - 1] if at else 0)
        return out

    def of_plain(self, text: str) -> list[int]:
        """Counts at each code point of a plain word in lower case."""
        counts, base = [], 0
        for part in common.PARTS.findall(text):
            counts += [base + c for c in self.of_part(part)]
            base = counts[-1]
        return counts

    def of_word(self, text: str) -> list[int]:
        """Counts at each code point of any word between white space."""
        counts, left, base = [], 0, 0
        for found in self.special.finditer(text):
            # until its last letter comes, a special token is text; then all of it is one
            region = self.of_region(text[left : found.end() - 1])
            counts += [base + c for c in region]
            base += (region[found.start() - left - 1] if found.start() > left else 0) + 1
            counts.append(base)
            left = found.end()
        return counts + [base + c for c in self.of_region(text[left:])]

    def of_words(self, words: list[bytes]) -> list[list[int]]:
        """Counts at each code point of each word. Words that are not plain are held against the library as wholes."""
        out, odd = [], []
        for raw in words:
            text = raw.decode()
            if self.plain and common.PLAIN_WORD.fullmatch(text):
                out.append(self.of_plain(text.lower()))
            else:
                odd.append((len(out), text))
                out.append(self.of_word(text))
        for (k, text), whole in zip(odd, self.encoded([t for _, t in odd]), strict=True):
            if out[k][-1] != whole:  # characters that the library's version of Unicode sees otherwise
                out[k] = self.encoded([text[:n] for n in range(1, len(text) + 1)])
        return out

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_texts(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each text, code points of each text, the changes of the count at all code points)."""
        if len(self.memory) > REMEMBERED:
            self.thin_out()
        if len(self.part) > REMEMBERED:
            self.part.clear()
            self.merges.shared.clear()
        words = common.Words(rows)
        hashes, first, code = words.distinct()
        known = self.memory.find(words, hashes, first)
        new = np.flatnonzero(known < 0)
        texts = sorted((words.word(k), i) for i, k in zip(new.tolist(), first[new].tolist(), strict=True))
        if texts:
            new = np.array([i for _, i in texts])
            found = self.of_words([w for w, _ in texts])
            known[new] = self.memory.add(words, hashes[new], first[new])
            sizes = np.array([len(c) for c in found])
            flat = np.array([x for c in found for x in c], np.int64)
            starts = np.cumsum(sizes) - sizes
            change = np.diff(flat, prepend=0)
            change[starts] = flat[starts]
            self.deltas = np.append(self.deltas, change.astype(np.int16))
            self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))
            self.total = np.append(self.total, flat[starts + sizes - 1])
            self.seen = np.append(self.seen, np.zeros(len(new), np.int64))
        self.seen[known] += np.bincount(code, minlength=len(first))
        code = known[code]
        letter = np.cumsum((words.data & 0xC0) != 0x80) - 1  # the code point of each byte
        chars = np.diff(np.concatenate([letter[words.begin[:-1]], [letter[-1] + 1]])) - 1 if rows else np.zeros(0, int)
        begin, size = self.begin[code], self.begin[code + 1] - self.begin[code]
        deltas = np.zeros(int(chars.sum()), np.int16)
        place = letter[words.start] - words.text  # without the gaps put between texts
        deltas[ragged(place, size)] = self.deltas[ragged(begin, size)]
        sums = np.concatenate([[0], np.cumsum(self.total[code])])
        return np.diff(sums[words.first]), chars, deltas


_SECOND: set[str] = set()


def starts_anew(c: str) -> bool:
    """Whether composition never joins this character with what stands before it."""
    if not _SECOND:
        pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
        _SECOND.update(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<"))
        _SECOND.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return not unicodedata.combining(c) and c not in _SECOND


_counters: dict[str, PrefixCounts] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored table (doc_id, n_bytes, n_chars, n_tokens, width, deltas): deltas are little-endian integers of `width` bytes."""
    path = path or default_path()
    names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "width", "deltas"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        if path not in _counters:
            _counters[path] = PrefixCounts(path)
        counter = _counters[path]
        for part in common.slices(batches):
            rows = common.raw_bytes(part.column("text"))
            tokens, chars, deltas = counter.of_texts(rows)
            width = 1 if not len(deltas) or np.abs(deltas).max() < 128 else 2
            flat, ends = deltas.astype(f"<i{width}"), np.cumsum(chars)
            packed = [squeeze(flat[e - n : e].tobytes()) for n, e in zip(chars.tolist(), ends.tolist(), strict=True)]
            columns = [part.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array(chars, pa.int64())]
            columns += [pa.array(tokens, pa.int64()), pa.array([width] * len(rows), pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id long, n_bytes long, n_chars long, n_tokens long, width int, deltas binary"
    return common.store(common.texts(docs).mapInArrow(run, kinds), "prefixes")


def counts_of(width: int, deltas: bytes) -> np.ndarray:
    """The count at each prefix, from that of no code point to that of all."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(deltas) if deltas else b""
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, f"<i{width}"), dtype=np.int64)])


def ask(table: DataFrame, budgets: list[int] = (), places: list[int] = ()) -> DataFrame:
    """The table's rows with `fits` (for each budget the longest prefix, in code points, whose count is within it) and `tokens_at`
    (for each place the tokens of the prefix up to it; null beyond the text), instead of the changes."""
    names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "fits", "tokens_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, at = [], []
            for width, deltas in zip(batch.column("width").to_pylist(), batch.column("deltas").to_pylist(), strict=True):
                counts = counts_of(width, deltas)
                fits.append([int(np.flatnonzero(counts <= b)[-1]) if b >= 0 else None for b in budgets])
                at.append([int(counts[p]) if 0 <= p < len(counts) else None for p in places])
            kind = pa.list_(pa.int64())
            columns = [*(batch.column(c) for c in names[:4]), pa.array(fits, kind), pa.array(at, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id long, n_bytes long, n_chars long, n_tokens long, fits array<long>, tokens_at array<long>"
    return table.mapInArrow(run, kinds)


def op11_prefix_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts read back from the stored prefixes; `fit_chars` is the longest prefix, in code points, within the limit."""
    answers = ask(prefix_table(common.read(spark, folder, "documents")), [LIMIT])
    fits = F.element_at("fits", 1)
    return answers.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), fits.alias("fit_chars")
    )

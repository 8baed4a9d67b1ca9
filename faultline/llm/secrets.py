"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens that adds spans.

A token is a run of letters and digits, or one other character. Each token is tagged O (outside), B (begin of a secret) or I
(inside). Features of a tag: the token's shape with and without its length, the tokens around it (hashed), and the file's shares of digits and symbols.
Weights are fitted to the pattern matches in a bounded sample of documents (where a long token is in no match but might be a secret,
nothing is learned), by full log-likelihood with forward-backward sums,
and every text is decoded by Viterbi. A text in which no token can gain from a tag other than O is all O, so only the others are
decoded step by step.

Defined results: a null or empty text has no spans. Repeated rows give repeated results, also without id. Without any pattern
match in the sample nothing is added. An empty table gives an empty one. Other columns aren't read by `secret_spans`; `redact`
passes them on, with text and n_chars renewed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common

#: Kinds in order, and their patterns.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Words without which no assignment matches, in lower case.
WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
#: Kind of the spans that the field adds, and their least length.
ADDED, LEAST_ADDED = "field", 8
#: Distinct texts that the field is fitted to: half of them those with likely matches, half of them any, by the smallest hashes.
SAMPLE = 4000
#: What lower-case texts with a pattern match hold.
LIKELY = "(password|passwd|secret|token|api_?key)[\"']? *[:=]|akia[a-z0-9]{12}|[0-9a-f]{32}"
#: Tokens of a training window, negative windows of a document, rounds, step and decay of the fit.
WINDOW, OTHERS, ROUNDS, STEP, DECAY = 24, 2, 50, 0.5, 1e-4
HASHES = 1 << 12
NEIGHBOURS = (-2, -1, 1)
FILES = 16
#: Token shapes: length (8), digits (4), letters' case (4), only hexadecimal digits (2), other character (2).
SHAPES = 8 * 4 * 4 * 2 * 2
PARTS = SHAPES // 8
#: Windows with a token that is at least so long, of letters and digits, and in no pattern match, teach nothing.
UNSURE = 16
MARK = "[SECRET]"


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) in code points, by start, then kind."""
    found = [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(kind, *m.span(), m.start()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Tokens:
    """Tokens of some texts as arrays, with the features of each."""

    def __init__(self, rows: list[bytes]):
        data = np.frombuffer(b"\n".join([*rows, b""]), np.uint8)
        digit = (data >= 48) & (data <= 57)
        upper = (data >= 65) & (data <= 90)
        lower = (data >= 97) & (data <= 122)
        high = data >= 128
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        word = digit | upper | lower | high
        other = ~word & ~gap
        before = np.concatenate([[False], word[:-1]])
        self.start = np.flatnonzero(other | (word & ~before))
        after = np.concatenate([word[1:], [False]])
        self.end = np.flatnonzero(other | (word & ~after)) + 1
        self.begin = np.cumsum([0, *(len(r) + 1 for r in rows)])
        self.first = np.searchsorted(self.start, self.begin)
        self.texts = len(rows)
        self.text = np.repeat(np.arange(self.texts), np.diff(self.first))
        size = self.end - self.start

        def count(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return sums[self.end] - sums[self.start]

        def share(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return (sums[self.begin[1:] - 1] - sums[self.begin[:-1]]) / np.maximum(np.diff(self.begin) - 1, 1)

        digits, uppers, lowers = count(digit), count(upper), count(lower)
        hexes = count(digit | ((data >= 97) & (data <= 102)) | ((data >= 65) & (data <= 70)))
        length = np.searchsorted([2, 4, 8, 12, 16, 24, 32], size, "right")
        part = (digits > 0).astype(np.int64) + (digits * 4 >= size) + (digits == size)
        case = (uppers > 0).astype(np.int64) * 2 + (lowers > 0)
        self.shape = (((length * 4 + part) * 4 + case) * 2 + (hexes == size)) * 2 + other[self.start]
        self.part = ((part * 4 + case) * 2 + (hexes == size)) * 2 + other[self.start]
        #: long tokens of letters and digits: where no pattern matches, they may be secrets or not
        self.unsure = (size >= UNSURE) & (digits > 0) & (lowers + uppers > 0)
        power, inverse = common.Words.powers(len(data))
        with np.errstate(over="ignore"):
            low = np.where(upper, data + 32, data).astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(low * power, out=sums[1:])
            value = common.mix((sums[self.end] - sums[self.start]) * inverse[self.start] ^ size.astype(np.uint64))
        # neighbours with digits or of unusual length say little by themselves: one value for each such shape
        plain = (digits == 0) & (size <= 16)
        self.word = np.where(plain, (value % np.uint64(HASHES - SHAPES)).astype(np.int64) + SHAPES, self.shape)
        files = np.searchsorted([0.002, 0.01, 0.05], share(digit), "right") * 4 + np.searchsorted([0.03, 0.08, 0.2], share(other), "right")
        self.file = files
        #: texts with a run of lower-case hexadecimal digits that is long enough
        run = np.concatenate([[False], digit | ((data >= 97) & (data <= 102)), [False]])
        edge = np.flatnonzero(run[1:] != run[:-1])
        long = edge[0::2][edge[1::2] - edge[0::2] >= LEAST["hex"]]
        self.hex = np.zeros(self.texts, bool)
        self.hex[np.searchsorted(self.begin, long, "right") - 1] = True

    def around(self, shift: int) -> np.ndarray:
        """The word value of the token `shift` places on in the same text; HASHES where there is none."""
        n = len(self.start)
        at = np.arange(n) + shift
        inside = (at >= self.first[self.text]) & (at < self.first[self.text + 1])
        return np.where(inside, self.word[np.clip(at, 0, max(n - 1, 0))] if n else 0, HASHES)


def emissions(tokens: Tokens, model: dict[str, np.ndarray]) -> np.ndarray:
    """(tokens x 3) scores of O, B and I."""
    out = model["shape"][tokens.shape] + model["part"][tokens.part] + model["file"][tokens.file[tokens.text]]
    for shift in NEIGHBOURS:
        out = out + model[f"word{shift}"][tokens.around(shift)]
    return out


#: I can't follow O or begin a text.
BARRED = np.array([[0, 0, -np.inf], [0, 0, 0], [0, 0, 0]])


def viterbi(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """Best tags of one text; ties take the smaller tag."""
    (s00, s01, _), (s10, s11, s12), (s20, s21, s22) = step.tolist()
    back: list[tuple[int, int, int]] = []
    o, b, i = 0.0, -np.inf, -np.inf  # before the first token: O
    for e0, e1, e2 in scores.tolist():
        to_o, to_b, to_i = (o + s00, b + s10, i + s20), (o + s01, b + s11, i + s21), (b + s12, i + s22)
        po = to_o.index(max(to_o))
        pb = to_b.index(max(to_b))
        pi = 1 if to_i[0] >= to_i[1] else 2
        back.append((po, pb, pi))
        o, b, i = to_o[po] + e0, to_b[pb] + e1, to_i[pi - 1] + e2
    last = [o, b, i]
    tag = last.index(max(last))
    tags = []
    for came in reversed(back):
        tags.append(tag)
        tag = came[tag]
    return tags[::-1]


def gold(tokens: Tokens, row: int, raw: bytes, text: str) -> np.ndarray:
    """Tags from the patterns: the first token of a secret is B, further ones I."""
    lo, hi = tokens.first[row], tokens.first[row + 1]
    tags = np.zeros(hi - lo, np.int64)
    for _, _, end, start in base_spans(text):
        a, b = (len(text[:x].encode()) + tokens.begin[row] for x in (start, end))
        inside = np.flatnonzero((tokens.end[lo:hi] > a) & (tokens.start[lo:hi] < b))
        tags[inside] = 2
        if len(inside) and (inside[0] == 0 or tags[inside[0] - 1] == 0):
            tags[inside[0]] = 1
    return tags


def windows(rows: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Training windows: features by name (windows x WINDOW), tags, and which places are filled."""
    features: dict[str, list] = {"shape": [], "part": [], "file": [], **{f"word{s}": [] for s in NEIGHBOURS}}
    tags, filled = [], []
    for raw in rows:
        tokens = Tokens([raw])
        n = len(tokens.start)
        if not n:
            continue
        y = gold(tokens, 0, raw, raw.decode())
        own = {"shape": tokens.shape, "part": tokens.part, "file": np.full(n, tokens.file[0]), **{f"word{s}": tokens.around(s) for s in NEIGHBOURS}}
        centres = list(np.flatnonzero(y == 1))
        # where no secret is: the longest tokens and those with the most unusual shapes, and one place by hash
        rest = np.flatnonzero(y == 0)
        size = tokens.end - tokens.start
        odd = rest[np.argsort(-(size[rest] + 8 * (tokens.word[rest] < SHAPES)), kind="stable")[:OTHERS]]
        centres += [*odd, int(common.mix(np.array([n], np.uint64))[0] % np.uint64(n))]
        for c in centres:
            a = int(np.clip(c - WINDOW // 2, 0, max(n - WINDOW, 0)))
            while a > 0 and y[a] == 2:  # a window doesn't begin inside a secret
                a -= 1
            b = min(a + WINDOW, n)
            if (tokens.unsure[a:b] & (y[a:b] == 0)).any():
                continue
            pad = WINDOW - (b - a)
            for k, v in own.items():
                features[k].append(np.pad(v[a:b], (0, pad)))
            tags.append(np.pad(y[a:b], (0, pad)))
            filled.append(np.arange(WINDOW) < b - a)
    shape = (0, WINDOW)
    as_array = lambda x, kind: np.array(x, kind) if x else np.zeros(shape, kind)
    return {k: as_array(v, np.int64) for k, v in features.items()}, as_array(tags, np.int64), as_array(filled, bool)


def fit(rows: list[bytes]) -> dict[str, np.ndarray]:
    """Weights by gradient ascent on the windows' log-likelihood, with per-weight steps."""
    features, tags, filled = windows(rows)
    sizes = {"shape": SHAPES, "part": PARTS, "file": FILES, **{f"word{s}": HASHES + 1 for s in NEIGHBOURS}}
    model = {k: np.zeros((v, 3)) for k, v in sizes.items()}
    model["step"] = np.zeros((3, 3))
    if not (tags == 1).any():
        model["shape"][:, 1:] = -100.0  # nothing to learn from
        return model
    n = len(tags)
    squares = {k: np.full_like(v, 1e-6) for k, v in model.items()}
    hot = np.eye(3)[tags] * filled[..., None]
    before = np.concatenate([np.zeros((n, 1), np.int64), tags[:, :-1]], axis=1)
    for _ in range(ROUNDS):
        scores = sum(model[k][v] for k, v in features.items())
        step = model["step"] + BARRED
        alpha = np.empty((n, WINDOW, 3))
        previous = np.tile([0.0, -np.inf, -np.inf], (n, 1))
        with np.errstate(divide="ignore"):
            for t in range(WINDOW):
                previous = scores[:, t] + np.logaddexp.reduce(previous[:, :, None] + step, axis=1)
                alpha[:, t] = previous
            beta = np.zeros((n, WINDOW, 3))
            for t in range(WINDOW - 2, -1, -1):
                on = np.logaddexp.reduce(step + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(filled[:, t + 1, None], on, 0.0)
            last = filled.sum(axis=1) - 1
            total = np.logaddexp.reduce(alpha[np.arange(n), last], axis=1)
            single = np.exp(alpha + beta - total[:, None, None]) * filled[..., None]
            came = np.concatenate([np.tile([0.0, -np.inf, -np.inf], (n, 1))[:, None], alpha[:, :-1]], axis=1)
            double = np.exp(came[..., None] + step + (scores + beta)[:, :, None, :] - total[:, None, None, None]) * filled[..., None, None]
        error = hot - single
        gradient = {k: np.zeros_like(v) for k, v in model.items()}
        for k, v in features.items():
            for y in range(3):
                gradient[k][:, y] = np.bincount(v.ravel(), error[..., y].ravel(), minlength=len(model[k]))
        seen = np.zeros((3, 3))
        np.add.at(seen, (before[filled], tags[filled]), 1)
        gradient["step"] = seen - double.sum(axis=(0, 1))
        for k in model:
            g = gradient[k] / n - DECAY * model[k]
            squares[k] += g * g
            model[k] += STEP * g / np.sqrt(squares[k])
    return model


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """The fitted weights. One task fits them to SAMPLE documents; only the weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [raw for batch in batches for raw in common.raw_bytes(batch.column("text"))]
        for name, value in fit(rows).items():
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [value.shape[0]], "value": [value.astype(np.float64).tobytes()]})

    rows = common.texts(docs).select(F.xxhash64("text").alias("h"), "text")

    def last(some: DataFrame) -> int | None:
        """The SAMPLE / 2-th smallest of distinct hashes; only hashes are sorted, the texts of the chosen ones are moved."""
        return some.select("h").distinct().orderBy("h").limit(SAMPLE // 2).agg(F.max("h")).first()[0]

    # half of the sample has likely matches, however rare these are
    likely = F.lower("text").rlike(LIKELY)
    bounds = [(rows.where(likely), last(rows.where(likely))), (rows, last(rows))]
    chosen = rows.limit(0)
    for some, bound in bounds:
        if bound is not None:
            chosen = chosen.unionByName(some.where(F.col("h") <= F.lit(bound)))
    chosen = chosen.dropDuplicates(["h"]).repartition(1).sortWithinPartitions("h").select("text")
    found = chosen.mapInArrow(run, "name string, rows long, value binary").collect()
    model = {r["name"]: np.frombuffer(r["value"], np.float64).reshape(r["rows"], 3) for r in found}
    return model or fit([])


def field_spans(tokens: Tokens, model: dict[str, np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """Of each text with any, the (first byte, end) of the secrets that the field tags."""
    if not len(tokens.start):
        return {}
    scores = emissions(tokens, model)
    step = model["step"] + BARRED
    # a tag other than O gains this much at most by the transitions into and out of it
    spare = 2 * max(0.0, float((model["step"] - model["step"][0, 0]).max()))
    gain = scores[:, 1:].max(axis=1) - scores[:, 0] + spare
    out: dict[int, list[tuple[int, int]]] = {}
    for row in np.unique(tokens.text[gain > 0]).tolist():
        lo, hi = int(tokens.first[row]), int(tokens.first[row + 1])
        tags = np.array(viterbi(scores[lo:hi], step))
        found = []
        for a in np.flatnonzero(tags == 1).tolist():
            b = a + 1
            while b < len(tags) and tags[b] == 2:
                b += 1
            start, end = int(tokens.start[lo + a]), int(tokens.end[lo + b - 1])
            found.append((start - int(tokens.begin[row]), end - int(tokens.begin[row])))
        if found:
            out[row] = found
    return out


def outside(start: int, end: int, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that lie in none of the others."""
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if b > start and a < end:
            if a > start:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def scan(rows: list[bytes], model: dict[str, np.ndarray]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, by start, then kind; of added ones the parts outside those of the patterns."""
    tokens = Tokens(rows)
    added = field_spans(tokens, model)
    out = []
    for k, raw in enumerate(rows):
        low = raw.lower()
        likely = tokens.hex[k] or b"AKIA" in raw or any(w in low for w in WORDS)
        if not likely and k not in added:
            out.append([])
            continue
        text = raw.decode()
        spans = [s[:3] for s in base_spans(text)] if likely else []
        own = list(spans)
        for a, b in added.get(k, []):
            start = len(raw[:a].decode())
            end = start + len(raw[a:b].decode())
            for x, y in outside(start, end, own):
                if y - x >= LEAST_ADDED:
                    spans.append((ADDED, x, y))
        out.append(sorted(spans, key=lambda s: (s[1], [*KINDS, ADDED].index(s[0]))))
    return out


def redacted(raw: bytes, spans: list[tuple[str, int, int]]) -> str:
    text, out, at = raw.decode(), [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind: string, start: long, end: long>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans_array(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], SPANS_ARROW)


def secret_spans(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, spans) of every row."""
    model = model or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            found = scan(common.raw_bytes(part.column("text")), model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans_array(found)], names=["doc_id", "spans"])

    return common.texts(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The documents with each secret replaced by MARK, and n_chars (where there is one) counted anew for changed texts."""
    model = model or learn(docs)
    names = docs.columns
    renewed = [c for c in names if c in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            raws = common.raw_bytes(part.column("text"))
            texts, counts = part.column("text").to_pylist(), part.column("n_chars").to_pylist() if "n_chars" in names else []
            for k, spans in enumerate(scan(raws, model)):
                if spans:
                    texts[k] = redacted(raws[k], spans)
                    if counts:
                        counts[k] = len(texts[k])
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            columns["text"] = pa.array(texts, part.schema.field("text").type)
            if counts:
                columns["n_chars"] = pa.array(counts, part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return common.map_whole(docs, run, {"text", "n_chars"}) if renewed else docs


def joined(spans: str, kinds: list[str] | None = None) -> Column:
    """`kind:start:end` of spans in their order, of given kinds only, comma-joined."""
    rows = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """The columns that both span scans return; kinds: those of the patterns."""
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined("spans", kinds).cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op8_secret_field(spark: SparkSession, folder: str) -> DataFrame:
    return digest(secret_spans(common.read(spark, folder, "documents")), KINDS)

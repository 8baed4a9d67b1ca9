"""Personal data: fixed patterns for protected entities, and terms around them that reveal what they are.

How strongly a term reveals an entity is estimated from the whole corpus, in two ways. For a kind of entity: the term's pointwise
mutual information with standing next to an entity of that kind, divided by the information content of the kind. For a single
value, as one e-mail address: its mutual information with standing in the same text as the value, over distinct texts, divided by
the information content of the value. Both ratios are 1 for a term that stands nowhere else. Terms next to an entity of the kind,
and terms anywhere in a text with the value, are replaced by a placeholder if the larger ratio reaches GENERALISE; from REMOVE on
they are removed. Both ways want SUPPORT: ten distinct values of a kind, or ten distinct texts with a value.

Joint counts of kinds take each (entity value, term) once, so copies of a document aren't evidence. The terms with enough support are then
counted exactly in all texts: a bit table of fixed size passes them in each task, and the join with them drops what it lets through.

Defined results: a null or empty text has no spans. Repeated rows give repeated results, also without id. An empty table gives
an empty one. Other columns aren't read by `personal_spans`; `sanitise` passes them on, with text and n_chars renewed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.llm.secrets import SPANS, SPANS_ARROW, digest

#: Kinds in order, and their patterns. A pattern that begins with digits can't match inside a run of digits where
#: it doesn't match at the run's begin, so it only looks there; e-mail addresses are found from their @.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kinds of the added spans.
ADDED = ["generalise", "remove"]
#: Terms on either side of an entity.
CONTEXT = 5
#: Distinct entity values of a kind a term must stand next to, or distinct texts in which it must stand with one value.
SUPPORT = 10
GENERALISE, REMOVE = 0.6, 0.9
#: Bits of a table that lets members of a set of hashes through; others that it lets through are dropped by an exact step later.
BITS = 1 << 26
#: Revealing terms of values up to which they are broadcast.
BROADCAST_TERMS = 500_000
#: Parts into which the terms of one value are dealt.
SALT = 16
#: Counted terms that a task holds before it passes them on.
HELD = 1 << 20
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DIGITS = re.compile(rb"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    found = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        # a part of many digits is over 255 unless it is mostly zeros
        if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def free_words(raw: bytes, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the terms of a text that lie in none of its spans."""
    words = common.Words([raw.translate(_LETTERS)])
    place = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    start, end = place[words.start], place[words.end]
    free = np.ones(len(start), bool)
    for _, a, b in spans:
        free[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = False
    return start[free], end[free], words.hashes()[free]


def value_hashes(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """The hash of each span's value, whatever its kind."""
    return common.Words([text[a:b].encode().translate(None, b" \t\n\x0b\x0c\r") for _, a, b in spans]).hashes()


def entities(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """The distinct entities of a text, by kind and value."""
    kinds = np.array([1 + KINDS.index(k) for k, _, _ in spans], np.uint64)
    return np.unique(common.mix(value_hashes(text, spans) ^ kinds))


def context(raw: bytes, text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The terms next to each span, none of them in a span: kind, hash of the entity's value, hash and place of the term."""
    start, end, hashes = free_words(raw, spans)
    hashes = hashes.view(np.int64)
    out = []
    for (kind, a, _), value in zip(spans, value_hashes(text, spans).view(np.int64).tolist(), strict=True):
        at = int(np.searchsorted(start, a))
        for i in range(max(0, at - CONTEXT), min(len(start), at + CONTEXT)):
            out.append({"kind": kind, "value": value, "term": int(hashes[i]), "start": int(start[i]), "end": int(end[i])})
    return out


CONTEXTS = "array<struct<kind: string, value: long, term: long, start: long, end: long>>"
CONTEXTS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("value", pa.int64()), ("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
)
FOUND = f"doc_id long, text_key long, spans {SPANS}, contexts {CONTEXTS}, values array<long>"


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: the entities of every row and the terms next to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            spans, near, values = [], [], []
            for raw in common.raw_bytes(part.column("text")):
                found = []
                if b"@" in raw or _DIGITS.search(raw):
                    text = raw.decode()
                    found = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                near.append(context(raw, text, found) if found else [])
                values.append(entities(text, found).view(np.int64) if found else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(spans, SPANS_ARROW), pa.array(near, CONTEXTS_ARROW)]
                + [pa.array(values, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "spans", "contexts", "values"],
            )

    return common.store(keyed(docs).mapInArrow(run, FOUND), "personal")


def keyed(docs: DataFrame) -> DataFrame:
    return common.texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def bit_table(rows: DataFrame, column: str) -> np.ndarray:
    """The low bits of the hashes of a column, as a table of BITS bits."""
    place = F.col(column).bitwiseAND(F.lit(BITS - 1)) + 1
    rows = rows.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("at"))
    table = np.zeros((BITS >> 15, 4096), np.uint8)
    for r in rows.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect():  # BITS / 8 bytes at most
        table[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return table.reshape(-1)


def maybe_in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be members; all members are."""
    place = hashes.astype(np.uint64) & np.uint64(BITS - 1)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, back, counts)
    return keys, out


def copies_of(found: DataFrame) -> tuple[int, np.ndarray]:
    """(number of distinct texts, bit table of the keys of repeated ones)."""
    copies = common.store(found.groupBy("text_key").agg(F.count("*").alias("n")), "copies")
    return copies.count(), bit_table(copies.filter("n > 1"), "text_key")


def count_terms(docs: DataFrame, wanted: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """(term, n) of the terms that a bit table lets through, in each distinct text once; the row without a term counts all terms.

    Texts that may be repeated give their counts under their key and are made distinct by a shuffle of these; all others are
    summed in their tasks."""

    def batch(key: int | None, terms: np.ndarray, counts: np.ndarray, total: int) -> pa.RecordBatch:
        values = [[key], [[*terms.view(np.int64).tolist(), None]], [[*counts.tolist(), total]]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["text_key", "terms", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part in common.slices(batches):
            keys = part.column("text_key").to_numpy()
            words = common.Words([r.translate(_LETTERS) for r in common.raw_bytes(part.column("text"))])
            hashes, again = words.hashes(), maybe_in(repeated, keys)
            near = maybe_in(wanted, hashes)
            for i in np.flatnonzero(again):
                own = slice(words.first[i], words.first[i + 1])
                yield batch(int(keys[i]), *np.unique(hashes[own][near[own]], return_counts=True), int(words.count[i]))
            total += int(words.count[~again].sum())
            own, n = np.unique(hashes[near & ~again[words.text]], return_counts=True)
            terms, counts = summed(np.concatenate([terms, own]), np.concatenate([counts, n]))
            if len(terms) > HELD:
                yield batch(None, terms, counts, 0)
                terms, counts = terms[:0], counts[:0]
        yield batch(None, terms, counts, total)

    rows = keyed(docs).select("text_key", "text").mapInArrow(run, "text_key long, terms array<long>, counts array<long>")
    rows = common.store(rows, "term-counts")
    once = rows.filter("text_key is not null").dropDuplicates(["text_key"])
    both = rows.filter("text_key is null").unionByName(once).select(F.explode(F.arrays_zip("terms", "counts")).alias("c"))
    return common.store(both.groupBy(F.col("c.terms").alias("term")).agg(F.sum("c.counts").alias("n")), "counts")


def revealing(docs: DataFrame, found: DataFrame, repeated: np.ndarray | None = None) -> DataFrame:
    """(kind, term, ratio) of the terms that reveal a kind of entity. Copies of a text count once, with entities and without."""
    if repeated is None:
        _, repeated = copies_of(found)
    near = found.select(F.explode("contexts").alias("c")).select("c.kind", "c.value", "c.term").distinct()
    joint = common.store(near.groupBy("kind", "term").agg(F.count("*").alias("joint")), "joint")
    kinds = joint.groupBy("kind").agg(F.sum("joint").alias("of_kind"))  # four rows at most
    joint = joint.filter(F.col("joint") >= SUPPORT)
    counts = count_terms(docs, bit_table(joint, "term"), repeated)
    total = counts.filter("term is null").select(F.col("n").alias("total"))
    rows = joint.join(counts, "term").join(F.broadcast(kinds), "kind").crossJoin(F.broadcast(total))
    seen = F.greatest("n", "joint").cast("double")
    information = F.greatest(F.log2(F.col("total") / F.col("of_kind")), F.lit(1e-9))
    shared = F.log2(F.col("joint") * F.col("total").cast("double") / (seen * F.col("of_kind")))
    return rows.select("kind", "term", (shared / information).alias("ratio")).filter(F.col("ratio") >= GENERALISE)


def holders(found: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The text keys of rows with a value that a bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values = part.column("values")
            row = pc.list_parent_indices(values).to_numpy()
            row = np.unique(row[maybe_in(wanted, values.flatten().to_numpy())])
            yield pa.RecordBatch.from_arrays([part.column("text_key").take(pa.array(row))], names=["text_key"])

    return found.select("text_key", "values").mapInArrow(run, "text_key long")


def summed_pairs(value: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (value, term) and the sums of their counts."""
    order = np.lexsort((term, value))
    value, term, n = value[order], term[order], n[order]
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (term[1:] != term[:-1]))) if len(n) else np.zeros(0, np.int64)
    return value[first], term[first], np.add.reduceat(n, first) if len(first) else n


Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def texts_with(rows: DataFrame, repeated: np.ndarray, pick: Callable[[list[bytes]], Pairs], name: str) -> DataFrame:
    """(value, term, n): in how many distinct texts each pair stands. pick: the distinct (text, value, term) of some texts, by text;
    all terms of a text with a value in one yield. Texts that may be repeated are made distinct by a shuffle, all others are summed
    in their tasks."""

    def batch(keys: pa.Array, value: np.ndarray, starts: np.ndarray, term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        terms = pa.ListArray.from_arrays(pa.array(np.append(starts, len(term)).astype(np.int32)), pa.array(term.view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(value.view(np.int64)), terms, pa.array(n)], names=["text_key", "value", "terms", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(value: np.ndarray, term: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(n), 1 << 16):
                part = value[i : i + (1 << 16)]
                yield batch(pa.nulls(len(part), pa.int64()), part, np.arange(len(part)), term[i : i + len(part)], n[i : i + len(part)])

        nothing = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, parts, waiting = nothing, [], 0
        for part in common.slices(batches):
            keys = part.column("text_key").to_numpy()
            again = maybe_in(repeated, keys)
            for text, value, term in pick(common.raw_bytes(part.column("text"))):
                may_repeat = again[text]
                if may_repeat.any():
                    own, own_value = text[may_repeat], value[may_repeat]
                    starts = np.flatnonzero(np.diff(own, prepend=-1))
                    yield batch(pa.array(keys[own[starts]]), own_value[starts], starts, term[may_repeat], np.ones(len(starts), np.int64))
                parts.append((value[~may_repeat], term[~may_repeat], np.ones(int((~may_repeat).sum()), np.int64)))
                waiting += len(parts[-1][2])
                if waiting > HELD:
                    held, parts, waiting = summed_pairs(*map(np.concatenate, zip(held, *parts, strict=True))), [], 0
                    if len(held[2]) > HELD:
                        yield from flat(*held)
                        held = nothing
        yield from flat(*summed_pairs(*map(np.concatenate, zip(held, *parts, strict=True))))

    rows = common.store(rows.mapInArrow(run, "text_key long, value long, terms array<long>, n long"), name)
    once = rows.filter("text_key is not null").dropDuplicates(["text_key", "value"])
    pairs = rows.filter("text_key is null").unionByName(once).select("value", F.explode("terms").alias("term"), "n")
    return pairs.groupBy("value", "term").agg(F.sum("n").alias("n"))


def revealing_values(docs: DataFrame, found: DataFrame, copies: tuple[int, np.ndarray] | None = None) -> DataFrame | None:
    """(value, term, ratio) of the terms that reveal a single entity; none if no entity stands in enough texts."""
    held = found.select("text_key", F.explode("values").alias("value")).distinct()
    values = common.store(held.groupBy("value").agg(F.count("*").alias("of_value")).filter(F.col("of_value") >= SUPPORT), "values")
    if values.isEmpty():
        return None
    n_texts, repeated = copies or copies_of(found)
    frequent = bit_table(values, "value")
    chosen = bit_table(holders(found, frequent), "text_key")

    def together(raws: list[bytes]) -> Pairs:
        for i, raw in enumerate(raws):
            text = raw.decode()
            spans = base_spans(text)
            own = entities(text, spans)
            own = own[maybe_in(frequent, own)]
            terms = np.unique(free_words(raw, spans)[2]) if len(own) else own
            for value in own:
                yield np.full(len(terms), i), np.full(len(terms), value), terms

    joint = texts_with(only(keyed(docs), chosen), repeated, together, "together").withColumnRenamed("n", "joint")
    joint = common.store(joint.filter(F.col("joint") >= SUPPORT), "value-terms")
    terms = bit_table(joint, "term")

    def alone(raws: list[bytes]) -> Pairs:
        words = common.Words([r.translate(_LETTERS) for r in raws])
        hashes = words.hashes()
        near = maybe_in(terms, hashes)
        text, term = common.distinct(words.text[near], hashes[near])
        yield text, np.zeros(len(term), np.uint64), term

    counts = texts_with(keyed(docs), repeated, alone, "alone").select("term", F.col("n").alias("of_term"))
    # a value may have many terms, so its count is dealt with some of them at a time
    salt = F.pmod("term", F.lit(SALT)).cast("int")
    salted = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = joint.join(counts, "term").withColumn("salt", salt).join(salted, ["value", "salt"])
    information = F.greatest(F.log2(F.lit(float(n_texts)) / F.col("of_value")), F.lit(1e-9))
    shared = F.log2(F.col("joint") * F.lit(float(n_texts)) / (F.col("of_term").cast("double") * F.col("of_value")))
    return rows.select("value", "term", (shared / information).alias("ratio")).filter(F.col("ratio") >= GENERALISE)


def only(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """The rows whose text key a bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array(maybe_in(chosen, part.column("text_key").to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def value_hits(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, ratio) of the terms that stand in a text with the value they reveal."""
    values = bit_table(terms, "value")
    pairs = bit_table(terms.select(F.col("value").bitwiseXOR(F.col("term")).alias("pair")), "pair")
    chosen = bit_table(holders(found, values), "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            keys = part.column("doc_id"), part.column("text_key")
            for i, raw in enumerate(common.raw_bytes(part.column("text"))):
                text = raw.decode()
                spans = base_spans(text)
                own = entities(text, spans)
                start, end, hashes = free_words(raw, spans)
                for value in own[maybe_in(values, own)]:
                    at = np.flatnonzero(maybe_in(pairs, hashes ^ value))
                    row = pa.array(np.full(len(at), i))
                    longs = [np.full(len(at), value).view(np.int64), hashes[at].view(np.int64), start[at], end[at]]
                    yield pa.RecordBatch.from_arrays(
                        [*[k.take(row) for k in keys], *[pa.array(x, pa.int64()) for x in longs]],
                        names=["doc_id", "text_key", "value", "term", "start", "end"],
                    )

    near = only(keyed(docs), chosen).mapInArrow(run, "doc_id long, text_key long, value long, term long, start long, end long")
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    return near.join(terms, ["value", "term"]).select("doc_id", "text_key", "start", "end", "ratio")


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans) of every row, by start, then kind; the added spans stand next to those of the patterns."""
    found = scan(docs)
    copies = copies_of(found)
    terms = common.store(revealing(docs, found, copies[1]), "terms")
    near = found.select("doc_id", "text_key", F.explode("contexts").alias("c")).select("doc_id", "text_key", "c.*")
    hits = near.join(terms, ["kind", "term"]).select("doc_id", "text_key", "start", "end", "ratio")
    of_values = revealing_values(docs, found, copies)
    if of_values is not None:
        hits = hits.unionByName(value_hits(docs, found, common.store(of_values, "value-ratios")))
    hits = hits.groupBy("doc_id", "text_key", "start", "end").agg(F.max("ratio").alias("ratio"))
    kind = F.when(F.col("ratio") >= REMOVE, F.lit(ADDED[1])).otherwise(F.lit(ADDED[0]))
    added = hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(kind.alias("kind"), "start", "end")).alias("added"))
    added = added.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    order = F.array(*map(F.lit, [*KINDS, *ADDED]))
    both = F.concat("spans", F.coalesce("added", F.array().cast(SPANS)))
    ranked = F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end")))
    back = F.transform(
        F.sort_array(ranked),
        lambda s: F.struct(F.element_at(order, s["rank"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return joined.select("doc_id", "text_key", back.alias("spans"))


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Entities become their kind, generalised terms a placeholder, removed terms nothing."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], {"remove": "", "generalise": "[TERM]"}.get(kind, f"[{kind.upper()}]")]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data and revealing terms taken out."""
    names = docs.columns
    spans = personal_spans(docs).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    spans = common.store(spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")), "spans")
    same = docs["doc_id"].cast("long").eqNullSafe(spans["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == spans["_key"])
    rows = docs.join(spans, same, "left").select(*[docs[c] for c in names], "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            texts = part.column("text").to_pylist()
            counts = part.column("n_chars").to_pylist() if "n_chars" in names else None
            for k, own in enumerate(part.column("_spans").to_pylist()):
                if own:
                    texts[k] = sanitised(texts[k], [(s["kind"], s["start"], s["end"]) for s in own])
                    if counts:
                        counts[k] = len(texts[k])
            columns = {c: part.column(c) for c in names}
            columns["text"] = pa.array(texts, part.schema.field("text").type)
            if counts:
                columns["n_chars"] = pa.array(counts, part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return rows.mapInArrow(run, docs.schema)


def ratio_of(joint: int, n: int, of_kind: int, total: int) -> float:
    """The ratio from its counts, for tests and reports."""
    return log2(joint * total / (max(n, joint) * of_kind)) / max(log2(total / of_kind), 1e-9)


def op7_revealing_terms(spark: SparkSession, folder: str) -> DataFrame:
    return digest(personal_spans(common.read(spark, folder, "documents")), KINDS)

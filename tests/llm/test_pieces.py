import random
import struct

import numpy as np
import pytest
import sentencepiece

from faultline.llm import pieces as pc

TEXTS = [
    None, "", " ", "  ", "\n", "a", " a b  c ", "Hello world, hello  World!\n\nNew   line \n", "été Über straße ñandú", "日本語 テスト 🎉 ▁ x▁y ▁",
    "\x00\x01\t\r\n\x0b", "ﬁ½ ​ é", "x" * 5000, "word " * 3000, "\n \n  \n", "a▁", "<0x41> <s> </s> <unk>",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pc.Vocabulary.load(pc.default_path())


def fields(data):
    """(number, wire type, value, raw bytes) of a message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        start = at
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value = data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            value = data[at : at + size]
            at += size
        yield key >> 3, kind, value, data[start:at]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_model(v):
    """The same pieces as a unigram model of the library, with this module's log scores."""
    out, i = b"", 0
    for number, _, value, raw in fields(open(pc.default_path(), "rb").read()):
        if number == 1:
            body = b"".join(r for n, _, _, r in fields(value) if n != 2) + b"\x15" + struct.pack("<f", v.score[i])
            out += b"\x0a" + varint(len(body)) + body
            i += 1
        elif number == 2:
            body = b"".join(r for n, _, _, r in fields(value) if n != 3) + b"\x18\x01"
            out += b"\x12" + varint(len(body)) + body
        else:
            out += raw
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def some_texts():
    rng = random.Random(4)
    alphabet = "abcdefghij éüñ\n.,-0123456789THEthe"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(200)]


def test_same_as_the_library(vocabulary):
    model = unigram_model(vocabulary)
    texts = [t for t in [*TEXTS, *some_texts()] if t and "▁" not in t and "<" not in t and "\x00" not in t]
    ids, sizes = pc.Encoder(vocabulary).encode([t.encode() for t in texts])
    different = 0
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        theirs = model.encode(text)
        if theirs != own.tolist():
            a, b = (sum(vocabulary.score[i] for i in x if not vocabulary.is_byte[i]) for x in (own.tolist(), theirs))
            assert abs(a - b) < 1e-3, text  # equally good up to the library's 32-bit sums
            different += 1
        assert model.decode(own.tolist()) == text
    assert different <= len(texts) // 10


def test_brute_force_viterbi(vocabulary):
    v = vocabulary
    names = {v.text[v.begin[i] : v.begin[i + 1]].tobytes(): i for i in range(len(v.score)) if not v.is_byte[i]}
    for part in (b" the", " naïve☃x".encode(), b"   internationalisation", b" aaaaaaaaab", b"\n"):
        ends = [i for i in range(len(part) + 1) if i == len(part) or part[i] & 0xC0 != 0x80]
        best = {0: 0.0}
        for a, b in zip(ends, ends[1:]):
            best[b] = -1e9
        for b in ends[1:]:
            for a in ends[: ends.index(b)]:
                single = ends.index(b) - ends.index(a) == 1
                if part[a:b] in names:
                    best[b] = max(best[b], best[a] + v.score[names[part[a:b]]])
                elif single:
                    best[b] = max(best[b], best[a] + v.unknown)
        ids, _ = pc.best_pieces([part], v)
        total = sum(v.score[i] for i in ids if not v.is_byte[i])
        unknown = sum(1 for c in part.decode() if c.encode() not in names and c.encode()[0] != 32)
        assert abs(total + unknown * v.unknown - best[len(part)]) < 1e-9


def test_round_trip_and_tables(spark, make_docs, vocabulary, monkeypatch):
    rows = [*enumerate(TEXTS), (3, "  "), (None, "no id")]
    found = pc.round_trip(make_docs(rows)).collect()
    assert len(found) == len(rows) and all(r.same for r in found)
    docs = pc.encode(make_docs(rows), ids_column="score")
    assert docs.columns == [*[c for c in make_docs(rows).columns if c != "score"], "score", "decodes"] and all(r.decodes for r in docs.collect())
    for r in docs.collect():
        assert pc.decode(np.array(r.score, np.int32), np.array([len(r.score)]), vocabulary) == [(r.text or "").encode()]
    assert pc.round_trip(make_docs([])).count() == 0 and pc.encode(make_docs([])).count() == 0
    monkeypatch.setattr(pc, "REMEMBERED", 3)
    few, many = pc.Encoder(vocabulary), [t.encode() for t in TEXTS if t]
    again = [few.encode([t])[0].tolist() for t in many]
    monkeypatch.setattr(pc, "REMEMBERED", 10**6)
    assert again == [pc.Encoder(vocabulary).encode([t])[0].tolist() for t in many]


def test_trie_holds_each_piece(vocabulary):
    trie, v = vocabulary.trie, vocabulary
    for i in range(300, len(v.score), 97):
        state = 0
        for c in v.text[v.begin[i] : v.begin[i + 1]].tolist():
            to = int(trie.base[state]) + c
            assert trie.check[to] == state
            state = to
        assert trie.value[state] == i

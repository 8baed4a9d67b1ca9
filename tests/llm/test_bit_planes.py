import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from faultline.llm import bit_planes as bp

TEXTS = [
    None, "", " ", "Hello World's don't 'll 's <|endoftext|> a<|startoftext|>b", "é ́x é ü z\u0085q", "ΣΑΣ Σ ΑΣ. İ ǅ",
    "日本語 🎉x y\x00z", "12 345 6a7b --- ...!?", "word " * 5000, "x" * 3000, "\t\n\x0b\x0c\r a\rb", "a b\x1cc\x1dd\x1ee",
]


def some_rows():
    rng = random.Random(8)
    words = ["The", "of", "ndthing", "été", "it's", "x,y.", "​", "<|", "ſt", "…"]
    rows = [(1000 - i, t) for i, t in enumerate(TEXTS)]
    rows += [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t", ""]) for _ in range(rng.randrange(60)))) for i in range(200)]
    return [*rows, (5, "again"), (5, "again"), (None, "no id")]


@pytest.mark.parametrize("step", [1, 8])
def test_read_back_matches_the_library(make_docs, step):
    rows = some_rows()
    tokenizer = Tokenizer.from_file(bp.default_path())
    blocks = bp.write_blocks(make_docs(rows), step=step, block_ids=500)
    found = sorted(bp.read_documents(blocks).collect(), key=lambda r: r.start)
    ids_of = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, bp.END_ID]
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start = 0
    want = {}
    for i, t in rows:
        ids = ids_of(t)
        want.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for r in found:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    shape = blocks.select("shard", "n_ids", "planes", "bits").collect()
    assert all(len(r.planes) == r.bits // step and r.n_ids <= 500 for r in shape) and sum(r.n_ids for r in shape) == start


def test_planes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 8, 9, 1000):
        for bits, step in ((16, 1), (16, 8), (32, 1), (32, 8)):
            ids = rng.integers(0, 2**bits, size=n, dtype=np.uint64).astype(np.uint32)
            lengths, payload = bp.pack(ids, bits, step)
            assert len(lengths) == bits // step and np.array_equal(bp.unpack(lengths, payload, n, bits)[0], ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers(name):
    import public_tokenizers

    encoder = bp.WordIds(public_tokenizers.path(name))
    assert encoder.by_word == name.startswith("word")
    texts = [t or "" for _, t in some_rows()]
    ids, sizes = encoder.encode([t.encode() for t in texts])
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, bp.END_ID] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_empty_table_and_forgetting(make_docs, monkeypatch):
    assert bp.read_documents(bp.write_blocks(make_docs([]))).count() == 0
    texts = [(t or "").encode() for t in TEXTS]
    whole = [bp.WordIds(bp.default_path()).encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(bp, "REMEMBERED", 2)
    few = bp.WordIds(bp.default_path())
    assert whole == [few.encode([t])[0].tolist() for t in texts]

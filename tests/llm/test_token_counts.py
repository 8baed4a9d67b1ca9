import random

import pytest
from tokenizers import Tokenizer

from faultline.llm import token_counts as tc

ODD = [
    None, "", " ", "Hello World's don't 'll 's <|endoftext|> a<|startoftext|>b", "!<|endoftext|<|endoftext|>'ve", "é x̣́ẹ́b",
    "ΣΑΣ Σ ΑΣ. İstanbul Ǆǅ", "日本語テキスト漢字 🎉x y\x00z", "12 345 6a7b --- ...!? ''''s ''re", "\t\n\x0b\x0c\r a\rb c 　d\x1ce\x85f",
    "한글", "naïve café it's we'll they've I'd", "가각 한글 ﷺ ½ ²x ９", "à́̕b̧'́s 'ŕe", "x" * 300,
    "Ṩ̣ q̣̇ Å Ω", "http://a.b/c?d=e&f='g'", "aaaaaaa abababab tototototo", "'", "''", "'l", "<|endoftex", "<|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tc.default_path())
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def random_texts(seed, n):
    rng = random.Random(seed)
    syllables = ["the", "ing", "er", "an", "è", "ou", "ß", "'s", "'", "re", "!", "..", "7", "tion", "S", "qu", "語", "<|endoftext|>", "́", " ", "\n", "-"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_every_prefix(library):
    counter = tc.PrefixCounts(tc.default_path())
    for text in [t or "" for t in ODD] + random_texts(1, 300):
        tokens, chars, deltas = counter.of_texts([text.encode()])
        found = deltas.cumsum().tolist()
        want = [library(text[:k]) for k in range(1, len(text) + 1)]
        assert found == want, (text, found, want)
        assert chars.tolist() == [len(text)] and tokens.tolist() == [library(text)]


def test_table_and_questions(make_docs, library, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    rows = list(enumerate([*ODD, *random_texts(2, 60), "word " * 5000])) + [(3, "again"), (3, "again"), (None, "no id")]
    table = tc.prefix_table(make_docs(rows))
    found = sorted(map(tuple, tc.ask(table, [0, 7, 2048], [0, 1, 10]).collect()), key=repr)
    want = []
    for i, text in rows:
        text = text or ""
        step = max(1, len(text) // 400) if len(text) > 1000 else 1
        counts = [library(text[:k]) for k in range(0, len(text) + 1)] if step == 1 else None
        at = [library(text[:p]) if p <= len(text) else None for p in (0, 1, 10)]
        fits = [max(k for k, c in enumerate(counts) if c <= b) for b in (0, 7, 2048)] if counts else [0, 35, 10240]
        want.append((i, len(text.encode()), len(text), library(text), fits, at))
    assert found == sorted(want, key=repr)
    assert tc.prefix_table(make_docs([])).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tc.PrefixCounts(public_tokenizers.path("byte_bpe_50k.json"))


def test_long_words_take_linear_time(library):
    import time

    counter = tc.PrefixCounts(tc.default_path())
    rng = random.Random(3)
    word = "".join(rng.choice("abcdeiounrst") for _ in range(60_000))
    started = time.perf_counter()
    tokens, _, _ = counter.of_texts([word.encode()])
    assert time.perf_counter() - started < 5 and tokens[0] == library(word)

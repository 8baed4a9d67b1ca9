import re

from faultline.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    starts, labels = [], set()
    for phrase, label in ls.BASE_PHRASES.items():
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


CASES = [
    None,
    "",
    "  \n\t ",
    "Licensed under the Apache License, Version 2.0.",
    "MIT-License mit license MIT\nLICENSE amit license mit licenses",
    "cc by cc by-nc; CC/BY/4.0 été cc by",
    "gnu general public license" * 3,
    "gnu general public licensé gnu GENERAL public\x00license",
    "word " * 30000 + "mit license",
    "İ K ſ mit license",
]


def test_base_matches_brute_force(make_docs):
    rows = {r.doc_id: r for r in ls.license_scan(make_docs(list(enumerate(CASES)))).collect()}
    assert len(rows) == len(CASES)
    for i, text in enumerate(CASES):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_expressions():
    assert ls.postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert ls.postfix("(MIT OR GPL-2.0-only WITH Classpath-exception-2.0) */") == ["MIT", "GPL-2.0-only", "Classpath-exception-2.0", "with", "or"]
    assert ls.postfix("MIT AND") == ["MIT", "and"][:1]
    assert ls.postfix("AND MIT") == [] and ls.postfix("((") == [] and ls.postfix("") == []
    assert ls.evaluate(ls.postfix("MIT OR GPL-3.0")) == ({"mit", "gpl"}, 1.0)
    assert ls.evaluate(ls.postfix("MIT AND GPL-3.0")) == ({"mit", "gpl"}, 0.2)
    assert ls.evaluate(ls.postfix("GPL-2.0 WITH Classpath-exception-2.0")) == ({"gpl"}, 0.5)
    assert ls.evaluate(ls.postfix("CC-BY-NC-4.0")) == ({"cc-by-nc"}, 0.1)


def test_tags_and_tables(make_docs, spark):
    text = "// SPDX-License-Identifier: (MIT OR GPL-2.0+) */\n# spdx-license-identifier:Zlib\nno tag"
    (r,) = ls.license_scan(make_docs([(7, text)])).collect()
    assert r.labels == "gpl,mit,zlib" and r.base_labels == "" and [t.expression for t in r.tags] == ["MIT GPL-2.0+ or", "Zlib"]
    assert r.score == 1.0
    assert ls.license_scan(make_docs([])).count() == 0
    assert ls.license_scan(make_docs([(None, "mit license"), (1, "a"), (1, "a")])).count() == 3


def test_long_lines_and_expressions_take_linear_time():
    import time

    started = time.perf_counter()
    machine = ls.automaton()
    r = ls.scan_text(b"mit license apache license " * 100_000, machine)
    assert (r["n_base"], r["first_word"], r["last_word"]) == (200_000, 0, 399_998)
    r = ls.scan_text(b"SPDX-License-Identifier: " + b" OR ".join([b"MIT"] * 200_000) + b"\n", machine)
    assert r["labels"] == "mit" and r["tags"][0]["expression"].count("or") == 199_999
    r = ls.scan_text(b"SPDX-License-Identifier: MIT " * 50_000, machine)
    assert len(r["tags"]) == 50_000
    assert time.perf_counter() - started < 8
    assert ls.postfix("(" * 50_000 + "MIT" + ")" * 49_999) == []

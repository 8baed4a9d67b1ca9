import random

import corpus_pipeline
from faultline.llm import near_dup, pieces, quality_rules, secrets

WORDS = [a + b for a in ("th", "on", "er", "re", "wh", "be", "st", "li") for b in ("an", "is", "ed", "ou", "ting", "al", "um")]


def write(spark, folder, rows, labels, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS `a.b`", "2 AS kept")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    clean = {i: text(120) for i in range(40)}
    item = text(60)
    rows = list(clean.items())
    rows += [(100 + i, clean[i]) for i in range(5)]  # copies
    rows += [(200 + i, clean[i + 5] + " one more") for i in range(5)]  # near copies
    rows += [(300, text(30) + " " + item + " " + text(30)), (301, f"{text(80)} password = hunter2hunter2 {text(20)}")]
    rows += [(400, "too short"), (401, None), (402, ""), (403, "the same words " * 60)]
    write(spark, tmp_path, rows, [(i, 1, 0) for i in clean], [(1, item), (2, None)])
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(clean) | {301}
    assert all(r.decodes and r["a.b"] == 1 and r.kept == 2 and r.n_chars == len(r.text) for r in out.values())
    assert all(out[i].text == t for i, t in clean.items())
    assert secrets.MARK in out[301].text and "hunter2" not in out[301].text
    v = pieces.Vocabulary.load(pieces.default_path())
    encoder = pieces.Encoder(v)
    assert all(r.piece_ids == encoder.encode([r.text.encode()])[0].tolist() for r in out.values())


def test_each_stage_on_the_rows_it_gets(spark, tmp_path):
    """A stage changes nothing but what it decides on: each equals its operator on what the stage before kept."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(80))) for i in range(20)] + [(50, None), (51, "x " * 100)]
    write(spark, tmp_path, rows, [(1, 1, 0)], [(1, "nothing of the kind")])
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, folder)
    kept = {r.doc_id for r in quality_rules.verdicts(docs, quality_rules.trusted_ids(spark, folder)).filter("kept").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == kept
    second = corpus_pipeline.near_duplicates(spark, first, folder)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == {r.doc_id for r in near_dup.deduplicate(first).collect()}
    third = corpus_pipeline.benchmark_leaks(spark, second, folder)
    assert third.columns == docs.columns and third.count() == second.count()
    fourth = corpus_pipeline.secret_redaction(spark, third, folder)
    assert fourth.columns == docs.columns and sorted(r.text for r in fourth.collect()) == sorted(r.text for r in third.collect())


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and found.columns[-2:] == ["piece_ids", "decodes"]

"""The stages on planted cases."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from rateline.llm.common import written


def test_stages_keep_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    clean = {i: text(150) for i in range(30)}
    item = text(40)
    rows = [(i, t, "en", f"s{i % 20}") for i, t in clean.items()]
    rows += [(100, clean[0], "en", "s1"), (101, " ".join([*clean[1].split()[:-1], "changed"]), "en", "s2"), (102, text(80) + " " + item + " " + text(80), "en", "s3"), (103, "12 34 !!", None, "s4"), (104, None, None, None), (None, text(100), None, None)]
    rows += [(200 + i, text(60) + "\nsubscribe to our letter now", "en", f"s{i}") for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, None) for r in rows], schema)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, str(tmp_path)), "stage")
        assert kept.columns == docs.columns, name
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(rows[i][0] for i in range(len(rows))) - set(seen["language ID"]) == {103, 104}
    assert sum("subscribe" in t for t in seen["line dedup"].values()) == 1
    assert set(seen["line dedup"]) - set(seen["SimHash near-dedup"]) == {100, 101}
    assert set(seen["SimHash near-dedup"]) - set(seen["benchmark decontamination"]) == {102}
    assert all(seen["benchmark decontamination"][i] == t for i, t in clean.items()) and None in seen["benchmark decontamination"]
    packed = pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(seen["benchmark decontamination"])
    assert pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_stages_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.count() == 0, name


def test_near_dedup_keeps_unlike_texts_of_one_id(spark, tmp_path):
    rng = random.Random(10)
    text = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a, "s2"), (1, b, "s1"), (1, c, "s1"), (1, a, "s1"), (2, b, "s0"), (None, c, "s1"), (None, text(), "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"], r["source"]) for r in pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([("1", a, "s1"), ("1", b, "s1"), ("1", c, "s1"), ("None", rows[-1][1], "s1")])

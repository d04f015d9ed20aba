"""Stages of the corpus pipeline against what they should do to a small table."""

import random
from collections import Counter

import corpus_pipeline


def prose(rng, n):
    common = "the of and to in is that it was for".split()
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(n))


def test_stages(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, prose(rng, 120) + ".", "en", "abc"[i % 3]) for i in range(60)]
    copy = rows[5][1].split()
    copy[30] = "changed"
    rows += [(100, rows[5][1], "en", "a"), (101, " ".join(copy), "en", "a"), (102, "too short", "en", "a"), (103, None, None, None), (104, "#$% " * 100, "en", "b"), (None, prose(rng, 90), "en", "c")]
    rows += [(105, prose(rng, 100) + " mail jane@x.org now", "en", "b")]
    docs = docs_of(rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good = corpus_pipeline.quality_rules(spark, docs, "").cache()
    assert {r.doc_id for r in good.collect()} == {*range(60), 100, 101, 105, None} and good.columns == docs.columns
    one = corpus_pipeline.near_duplicate_join(spark, good, "").cache()
    assert Counter(r.doc_id for r in one.collect()) == Counter([*range(60), 105, None])
    clean = corpus_pipeline.personal_data(spark, one, "").cache()
    assert clean.filter("doc_id = 105").first().text.endswith("mail <email> now") and clean.count() == one.count()
    mixed = corpus_pipeline.source_mix(spark, clean, "").cache()
    assert mixed.columns == docs.columns and mixed.count() > 0
    last = corpus_pipeline.sentence_pieces(spark, mixed, "")
    assert last.count() == mixed.count() and last.filter("NOT lossless").count() == 0


def test_run(spark, docs_of, tmp_path):
    rng = random.Random(2)
    docs_of([(i, prose(rng, 60), "en", "ab"[i % 2]) for i in range(12)]).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert set(out.columns) == {"doc_id", "ids", "n_pieces", "lossless"} and out.count() > 0

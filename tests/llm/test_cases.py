"""Cases that every operator on documents must take: clashing columns, empty tables, and stages of the pipeline on them."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barsmith.llm import mixing, ngramjoin, pieces, pii, quality, spots, toxicity
from barsmith.llm.tokencount import token_counts

CLASH = "key id node label labels set run size shares take row own text_key target quota group shard range halo tie next spots score toxic base spans n_added kept tokens copy rejected _id _key _take page_id word_hist".split()
OPERATORS = {
    "op1": lambda d, labels: pii.personal_data(d), "op2": lambda d, labels: ngramjoin.near_duplicates(d), "op3": lambda d, labels: token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op4": lambda d, labels: pieces.encoded(d, public_tokenizers.path("piece_bpe_32k.model")).withColumn("ids", F.col("ids").cast("string")), "op5": lambda d, labels: quality.quality(d),
    "op7": lambda d, labels: toxicity.toxicity(d, labels), "op8": lambda d, labels: spots.edited(d), "op10": lambda d, labels: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_empty_tables(spark, docs_of, odd_rows, name):
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 1), (7, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(odd_rows)
    clash = docs.withColumns({c: F.lit("x") for c in CLASH})
    plain = Counter(map(tuple, OPERATORS[name](docs, labels).collect()))
    assert Counter(map(tuple, OPERATORS[name](clash, labels).collect())) == plain and plain.total() == len(odd_rows)
    assert OPERATORS[name](clash.limit(0), labels).count() == 0


def test_stages_with_clashing_columns_and_none(spark, docs_of, odd_rows):
    rows = [(100 + i, " ".join(f"w{i}x{j}" for j in range(60)) + " the of and", "en", "ab"[i % 2]) for i in range(8)]
    docs = docs_of(odd_rows + rows).withColumns({c: F.lit("x") for c in CLASH})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0
        docs = stage(spark, docs, "").cache()
        assert docs.columns[-len(CLASH) :] == CLASH and docs.count() > 0
        assert docs.filter("key <> 'x' OR _take <> 'x'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_given_references_judge_shards_alike(docs_of):
    import random

    rng = random.Random(3)
    common = "the of and to in is that it was for".split()

    def prose():
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(150)) + "."

    rows = [(i, prose(), "en", "a") for i in range(60)] + [(100 + i, " ".join("".join(rng.choices("#$%&*|", k=6)) for _ in range(150)), "en", "a") for i in range(4)]
    whole = {r.doc_id: (r.char_distance, r.word_distance, r.kept) for r in quality.quality(docs_of(rows)).collect()}
    given = quality.fit_references(docs_of(rows))
    shard = docs_of(rows[-6:])
    got = {r.doc_id: (r.char_distance, r.word_distance, r.kept) for r in quality.quality(shard, given=given).collect()}
    assert got == {d: whole[d] for d in got} and not any(got[100 + i][2] for i in range(4)) and got[58][2]
    # Marks and case do not hide a common word.
    assert [quality.bare(w) for w in (b"The", b"the,", b"(the)", "Él".encode(), b"th", b"")] == [b"the", b"the", b"the", "él".encode(), b"th", b""]

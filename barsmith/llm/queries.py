"""The registered queries of the text operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import table, work_dir
from barsmith.llm.oracle import merkle_sql, repair_sql


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.pii import personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.ngramjoin import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barsmith.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barsmith.llm.pieces import encoded

    found = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "lossless")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.warc import page_records, read_archives, write_archives

    path = work_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return page_records(read_archives(spark, path, with_payload=False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.spots import edited

    return edited(table(spark, sf_dir, "documents"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.html import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.repair import damaged, repairs

    conversations = table(spark, sf_dir, "conversations")
    return repairs(conversations, damaged(conversations))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.exactdedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barsmith.llm.merkle import every_fifth, manifest

    return manifest(table(spark, sf_dir, "documents"), every_fifth())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_personal_data, op2_ngram_join, op3_token_counts, op4_sentencepiece, op5_quality_rules, op6_warc, op7_toxicity, op8_spot_signatures, op9_page_text, op10_source_mix, op11_conversation_repair, op12_exact_dedup, op13_merkle_manifest)
}
ORACLE_SQL: dict[str, str] = {
    # All pairs by shared run of words: for small tables.
    "op2_ngram_join": r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id, count(*) AS n_copies FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
z AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS root FROM t UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.root),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY 1),
k AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, c.class_id, coalesce(k.n_links, 0) AS n_links, coalesce(t.n_copies, 1) AS n_copies
FROM documents d LEFT JOIN t ON d.doc_id IS NOT NULL AND t.text = coalesce(d.text, '') LEFT JOIN c ON c.id = t.id LEFT JOIN k ON k.id = t.id""",
    "op11_conversation_repair": repair_sql(),
    "op13_merkle_manifest": merkle_sql(),
    "op12_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT t.*, keep_id, n, row_number() OVER (PARTITION BY t.text, doc_id) AS copy FROM t JOIN g ON g.text = t.text)
SELECT doc_id, keep_id, n AS group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(text) AS text_sha256 FROM r""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN greatest(1, ceil(n / 1048576))::BIGINT ELSE 1 END AS chunks, true AS intact
FROM d LEFT JOIN f ON f.h = d.h""",
}

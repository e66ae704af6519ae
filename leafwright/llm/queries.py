"""The thin queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bayes_svm, decontaminate, heap_lloyd, html_text, merkle, packing, pii, quality_rules, secrets, simhash, substring, voronoi, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(*quality_rules.CONTRACT)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, size=4)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "stop", F.sha2("secret", 256).alias("secret_sha256"), "score")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bayes_svm.score(docs, bayes_svm.train(docs, table(spark, sf_dir, "labels")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), F.when(tampered, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text")))


def op12_voronoi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_pii": op5_pii,
    "op6_html_extraction": op6_html_extraction,
    "op7_warc_index_merge": op7_warc_index_merge,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_voronoi_search": op12_voronoi_search,
    "op13_heap_lloyd": op13_heap_lloyd,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
    "op12_voronoi_search": voronoi.oracle(),
    "op13_heap_lloyd": heap_lloyd.oracle(),
    "op7_warc_index_merge": """
        with p as (
            select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
            from pages
        ), f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1),
        k as (
            select page_id, split_part(split_part(split_part(regexp_replace(split_part(lower(coalesce(url, '')), '#', 1), '^[a-z][a-z0-9+.-]*://(www[0-9]*[.])?', ''), '/', 1), '?', 1), ':', 1) as host,
                regexp_replace(regexp_replace(split_part(lower(coalesce(url, '')), '#', 1), '^[a-z][a-z0-9+.-]*://(www[0-9]*[.])?', ''), '^[^/?]*', '') as rest,
                strftime(timestamp '2024-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') as captured
            from pages
        ), u as (select page_id, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest as url_key, captured from k)
        select p.page_id, payload_bytes, p.payload_digest,
            case when p.page_id > first then 'revisit' else 'response' end as record_type,
            case when p.page_id > first then first end as refers_to,
            url_key, captured, row_number() over (order by url_key, captured, p.page_id) as history
        from p join u on u.page_id = p.page_id left join f on f.payload_digest = p.payload_digest""",
}

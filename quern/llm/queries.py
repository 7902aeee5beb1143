"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import table
from quern.llm.conversations import REPAIR_SQL, repair_conversations
from quern.llm.decontam import DECONTAMINATION_SQL, benchmark_leaks
from quern.llm.lines import LINE_RUNS_SQL, drop_repeated_lines
from quern.llm.merkle import MANIFEST_SQL, manifest
from quern.llm.neardup import NEAR_DUPLICATES_SQL, near_duplicates
from quern.llm.packing import best_fit_pack
from quern.llm.pieces import piece_digests
from quern.llm.pii import find_personal
from quern.llm.quality import QUALITY_SQL, host_rules
from quern.llm.secrets import find_secrets
from quern.llm.shards import training_order
from quern.llm.toxicity import toxic_scores
from quern.llm.warc import capture_histories


def op1_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op3_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = capture_histories(table(spark, sf_dir, "pages"))
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return captures.select(*first, "urlkey", "captured_at", "position")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).drop("host", "host_rates", "host_failed")


def op6_repeated_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


def op10_voted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents")).drop("found")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_benchmark_containment": op1_benchmark_containment,
    "op2_linked_secrets": op2_linked_secrets,
    "op3_warc_index_merge": op3_warc_index_merge,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_host_rules": op5_host_rules,
    "op6_repeated_line_runs": op6_repeated_line_runs,
    "op7_training_order": op7_training_order,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_minmax_near_dedup": op9_minmax_near_dedup,
    "op10_voted_personal_data": op10_voted_personal_data,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_piece_round_trip": op13_piece_round_trip,
}

SQL: dict[str, str] = {
    "op1_benchmark_containment": DECONTAMINATION_SQL,
    "op3_warc_index_merge": r"""
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), r AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM p
        ), k AS (
            SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS rest FROM r
        ), s AS (
            SELECT *, array_to_string(list_reverse(string_split(regexp_replace(lower(host), '^www[0-9]*\.', ''), '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS urlkey,
                strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
            FROM k
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN stored END AS refers_to,
            urlkey, captured_at, row_number() OVER (ORDER BY urlkey, captured_at, page_id) - 1 AS position
        FROM s""",
    "op5_host_rules": QUALITY_SQL,
    "op6_repeated_line_runs": LINE_RUNS_SQL,
    "op9_minmax_near_dedup": NEAR_DUPLICATES_SQL,
    "op11_merkle_manifest": MANIFEST_SQL,
    "op12_conversation_repair": REPAIR_SQL,
}

"""The corpus pipeline: toxicity, line runs, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is stored as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, with any further columns
whatever they are called; rows without doc_id are judged by toxicity alone and packed. Decisions that may concern
a large part of the documents are joined by exchange at every size: no table that grows is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table, written
from quern.llm.decontam import benchmark_leaks
from quern.llm.lines import cut_texts
from quern.llm.neardup import near_duplicates
from quern.llm.packing import best_fit_pack
from quern.llm.toxicity import THRESHOLD, fit, scored

#: Rows of an Arrow batch, a setting of the pipeline's session: rows hold whole texts, and this stage's are not stored twice.
BATCH = 500
#: SQL can't express the learned scores, the tokenizer and the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _quoted(columns: list[str]) -> list[str]:
    """Names as they stand, with dots and back-ticks."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    model, rows = fit(docs, table(spark, sf_dir, "labels")), docs.select(F.struct("*").alias("document"), "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return scored(rows, model, ["document"]).where(F.col("score") < THRESHOLD).select("document.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those of which nothing is left go."""
    left = cut_texts(docs).where((F.col("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        size = F.when(F.col("removed") > 0, F.length("text")).otherwise(F.col("row")["n_chars"])
        fresh["n_chars"] = size.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*(fresh.get(c, F.col("row")[c].alias(c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    others = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(written(others, "others").hint("merge"), "doc_id", "left_anti").select(_quoted(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    leaks = benchmark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(written(leaks, "leaks"), "doc_id", "left_anti").select(_quoted(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return best_fit_pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

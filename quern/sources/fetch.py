"""What comes from elsewhere: downloads, services asked key by key and resumed, snapshots joined by keys."""

from __future__ import annotations

import os
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.select import keep_first
from quern.sources.readers import delimited
from quern.sources.work import exists, stored


class Passing(Exception):
    """A failure that may pass: another try is worth while."""


def download(url: str, target: str, timeout: float = 60.0) -> str | None:
    """Fetch url into the driver's file target unless it is there; returns when the source was last changed, if it says so.

    The file appears whole or not at all: it is written beside its place, its length is held against
    the announced one, and it is renamed.
    """
    if os.path.exists(target):
        return None
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    beside = f"{target}.{uuid.uuid4().hex}"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer, open(beside, "wb") as file:
            size = 0
            while block := answer.read(1 << 20):
                size += file.write(block)
            announced = answer.headers.get("Content-Length")
            if announced is not None and int(announced) != size:
                raise Passing(f"{url}: {size} of {announced} bytes")
            changed = answer.headers.get("Last-Modified")
        os.replace(beside, target)
        return changed
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def patiently(ask: Callable, tries: int = 4, wait: float = 5.0, pause: Callable[[float], None] = time.sleep) -> Callable:
    """ask, tried again after a passing failure, with a wait that grows by the try; the last failure is raised."""

    def asked(key):
        for attempt in range(1, tries + 1):
            try:
                return ask(key)
            except Passing:
                if attempt == tries:
                    raise
                pause(wait * attempt)

    return asked


def in_hops(*hops: Callable) -> Callable:
    """A look-up over several services: each hop takes what the one before gave; the first that gives None ends it with None."""

    def asked(key):
        for hop in hops:
            key = hop(key)
            if key is None:
                return None
        return key

    return asked


def canonical_or_longest(records: Iterable[dict], canonical: str = "canonical", value: str = "seq") -> str | None:
    """The canonical record's value, else the longest value (the first of equals), None without any."""
    records = [r for r in records if r.get(value)]
    chosen = [r for r in records if r.get(canonical)] or records
    return max((r[value] for r in chosen), key=len, default=None)


def resumed(spark: SparkSession, keys: DataFrame, ask: Callable, schema: str, path: str, page: int = 1000, at_once: int = 8, per_second: float | None = None) -> DataFrame:
    """The answers for all keys (column key), asking only for those that path doesn't hold yet.

    ask(key) returns a list of tuples of schema, which may be empty, and raises Passing if it can't say.
    Each answer is kept with its key and state: found, empty (known to have no answer) or failed; failed
    keys are asked again by the next run. The open keys are a stored table, dealt into rounds of at_once
    tasks with about page keys each. A round's answers are appended to path before the next one begins, so a run that
    ends early goes on behind its last round. Tasks together make at most per_second calls. No key
    passes the driver. Returns key, state and the answer's columns.
    """
    full = f"key STRING, state STRING, {schema}"
    names = spark.createDataFrame([], full).columns
    held = spark.read.schema(full).parquet(path) if exists(spark, path) else spark.createDataFrame([], full)
    asked = keys.select(F.col("key").cast("string")).distinct()
    todo = stored(asked.join(held.where("state <> 'failed'").select("key").distinct(), "key", "left_anti"), "open_keys")
    rounds = -(-todo.count() // (page * at_once))
    gap = at_once / per_second if per_second else 0.0

    def answers(frames):
        import pandas as pd

        last = 0.0
        for frame in frames:
            for a in range(0, len(frame), 100):
                rows = []
                for key in frame["key"][a : a + 100]:
                    time.sleep(max(0.0, last + gap - time.monotonic()) if last else 0.0)
                    last = time.monotonic()
                    try:
                        got = [(key, "found", *r) for r in ask(key)] or [(key, "empty", *[None] * (len(names) - 2))]
                    except Passing:
                        got = [(key, "failed", *[None] * (len(names) - 2))]
                    rows += got
                yield pd.DataFrame(rows, columns=names, dtype=object)

    for r in range(rounds):
        mine = todo.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r)
        mine.repartition(at_once, "key").mapInPandas(answers, full).write.mode("append").parquet(path)
    rows = spark.read.schema(full).parquet(path) if exists(spark, path) else held
    settled = rows.where("state <> 'failed'")
    failed = rows.where("state = 'failed'").join(settled.select("key").distinct(), "key", "left_anti").distinct()
    return settled.unionByName(failed).join(asked, "key", "left_semi")


def accessions(spark: SparkSession, path: str) -> DataFrame:
    """gene_symbol, uniprot_ac from a headerless table: complete rows, the first of each gene."""
    rows = delimited(spark, path, "uniprot_ac STRING, gene_symbol STRING", sep="\t", header=False)
    return keep_first(rows.where("uniprot_ac is not null and gene_symbol is not null"), ["gene_symbol"], [F.col("uniprot_ac")])


def cached_sequences(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """gene, seq from JSON objects of key and sequence, one a line, or one a file if whole; a null sequence is none."""
    objects = spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", "map<string,string>")).alias("gene", "seq"))
    return objects.where("seq is not null and seq <> ''")


def keep_sequences(rows: DataFrame, path: str) -> None:
    """Add gene, seq to the cache at path, a JSON object a task; what is there stays."""
    pairs = F.map_from_entries(F.collect_list(F.struct("gene", "seq")))
    rows.groupBy(F.pmod(F.xxhash64("gene"), F.lit(16)).alias("part")).agg(F.to_json(pairs).alias("value")).select("value").write.mode("append").text(path)


def first_hits(df: DataFrame, snapshot: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """df with the values of the first row of the snapshot, in an order, that has all its keys; null without one."""
    hits = keep_first(snapshot.select(*keys, *values, *(c for c in order if c not in (*keys, *values))), keys, [F.col(c) for c in order])
    return df.drop(*values).join(hits.select(*keys, *values), keys, "left")


#: Where a service's answer has each score.
ANSWER_PATHS = {
    "cadd_phred": "$.cadd.phred",
    "revel_score": "$.dbnsfp.revel.score",
    "polyphen2_hdiv": "$.dbnsfp.polyphen2.hdiv.score",
    "polyphen2_hvar": "$.dbnsfp.polyphen2.hvar.score",
    "sift_score": "$.dbnsfp.sift.score",
    "phylop_primate": "$.dbnsfp.phylo.p17way.primate",
    "phastcons_primate": "$.dbnsfp.phastcons.17way.primate",
    "gerp_rs": "$.dbnsfp['gerp++'].rs",
}


def service_scores(answer: Column) -> dict[str, Column]:
    """Scores of an answer (JSON text): a number, or the median of a list's numbers; null where any part of the way is absent."""

    def number(path: str) -> Column:
        text = F.get_json_object(answer, path)
        values = F.filter(F.transform(F.split(F.regexp_replace(text, r"[\[\]\s\"]", ""), ","), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
        ordered, n = F.array_sort(values), F.size(values)
        middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / F.lit(2.0)
        return F.when(n > 0, middle)

    return {name: number(path) for name, path in ANSWER_PATHS.items()}

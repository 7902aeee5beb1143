"""Provenance told by the tasks that write, digests of input files, run documents of differing shape, a session without settings."""

import hashlib
import http.server
import json
import os
import subprocess
import sys
import threading
import urllib.error
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.sources import fetch, readers, sinks

ROOT = Path(__file__).resolve().parents[1]


def test_recorded_stage(spark, tmp_path):
    source = spark.range(100).select("id", (F.col("id") * 2).alias("a.b"))
    source.repartition(3).write.parquet(f"file://{tmp_path}/in")
    df = spark.read.parquet(f"file://{tmp_path}/in").where("id < 60")
    told = sinks.recorded(df, f"file://{tmp_path}/out", "here", version="v1", note="x")
    again = sinks.recorded(df.repartition(5), f"file://{tmp_path}/again", "here")
    assert (told["rows"], told["n_files"], told["version"], told["note"]) == (60, 3, "v1", "x")
    assert told["checksum"] == again["checksum"] and told["files_digest"] == again["files_digest"]
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 60
    files = {os.path.basename(p): (n, d) for p, n, d in spark.read.parquet(f"file://{tmp_path}/out.inputs").collect()}
    for name, (length, digest) in files.items():
        data = Path(f"{tmp_path}/in/{name}").read_bytes()
        assert (len(data), hashlib.md5(data).hexdigest()) == (length, digest)
    made = sinks.recorded(spark.range(3), f"file://{tmp_path}/made", "made")
    assert (made["rows"], made["n_files"], made["bytes"]) == (3, 0, 0)


def test_documents_of_differing_shape(spark, tmp_path):
    for name, doc in {"a": {"run": 1, "metrics": {"auc": 0.5}}, "b": {"run": 2, "metrics": "failed", "folds": [{"auc": 1}, {}]}, "c": {"other": None}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    docs = readers.artefacts(spark, f"file://{tmp_path}/*.json")
    rows = readers.artefact_fields(docs, {"run": ("$.run", "long"), "auc": ("$.metrics.auc", "double"), "text": ("$.metrics", "string")})
    got = {os.path.basename(r.file): (r.run, r.auc) for r in rows.collect()}
    assert got == {"a.json": (1, 0.5), "b.json": (2, None), "c.json": (None, None)}
    folds = readers.artefact_entries(rows, "$.folds", ["run"]).select("run", "pos", F.try_variant_get("value", "$.auc", "double").alias("auc"))
    assert sorted(map(tuple, folds.collect()), key=str) == [(2, 0, 1.0), (2, 1, None)]


def test_session_without_settings(tmp_path):
    """A plain local session, no Spark configuration: a query that stores tables runs, and its folder is one an application."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as e\n"
        "from quern.sources.work import shared_dir, remove_work_tables\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "d = '/root/testdata/sf0.001'\n"
        "names = [n for n in ('stage_round_trip', 'op12_conversation_repair') if n in e.queries()]\n"
        "print('counts', [e.queries()[n](s, d).count() > 0 for n in names], shared_dir(s) == shared_dir(s))\n"
        "remove_work_tables(s)\n"
    )
    conf = tmp_path / "conf"
    conf.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "counts [True" in done.stdout and "False" not in done.stdout, done.stdout + done.stderr[-2000:]


class _Service(http.server.BaseHTTPRequestHandler):
    """gene to id to transcript to sequence; every fifth sequence is refused at first, every seventh gene is unknown."""

    asked: list[str] = []

    def do_GET(self):
        kind, key = self.path.strip("/").split("/")
        self.asked.append(self.path)
        n = int(key)
        refused = kind == "seq" and n % 5 == 0 and self.asked.count(self.path) < 3
        answer = {"gene": None if n % 7 == 0 else n + 1000, "id": n + 1000, "seq": f"ATG{n}"}[kind]
        self.send_response(503 if refused else 200)
        self.end_headers()
        self.wfile.write(b"" if refused else json.dumps(answer).encode())

    def log_message(self, *_):
        pass


def test_service_of_three_hops_is_asked_in_rounds(spark, tmp_path):
    """Rounds of bounded tasks; a run that ends early is gone on with; refused keys are asked again, settled ones aren't."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, stop = f"http://127.0.0.1:{server.server_port}", tmp_path / "stop"

    def hop(kind):
        def asked(key):
            try:
                with urllib.request.urlopen(f"{base}/{kind}/{key}", timeout=10) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as error:
                raise fetch.Passing(kind) from error

        return asked

    find = fetch.in_hops(hop("gene"), hop("id"), hop("seq"))

    def ask(key):
        if stop.exists() and int(key) == 17:
            raise RuntimeError("the run ends here")
        found = find(key)
        return [] if found is None else [(found, len(found))]

    keys, path = spark.range(40).select(F.col("id").alias("key")), f"file://{tmp_path}/answers"
    stop.touch()
    with pytest.raises(Exception, match="the run ends here"):
        fetch.resumed(spark, keys, ask, "seq STRING, size INT", path, page=3, at_once=2)
    stop.unlink()
    kept = spark.read.parquet(path).count() if os.path.exists(f"{tmp_path}/answers") else 0
    before = len(_Service.asked)
    first = fetch.resumed(spark, keys, ask, "seq STRING, size INT", path, page=3, at_once=2, per_second=400)
    states = {int(r.key): r.state for r in first.collect()}
    assert set(states) == set(range(40)) and all(states[k] == "empty" for k in range(0, 40, 7))
    assert sum(p.startswith("/gene/") for p in _Service.asked[before:]) <= 40 - kept + 8
    fetch.resumed(spark, keys, ask, "seq STRING, size INT", path)
    before = len(_Service.asked)
    last = {int(r.key): (r.state, r.seq, r.size) for r in fetch.resumed(spark, keys, ask, "seq STRING, size INT", path).collect()}
    assert all(last[k] == ("found", f"ATG{k + 2000}", len(f"ATG{k + 2000}")) for k in range(40) if k % 7)
    fetch.resumed(spark, keys, ask, "seq STRING, size INT", path)
    assert len([p for p in _Service.asked[before:] if p.startswith("/gene/")]) <= 8
    server.shutdown()

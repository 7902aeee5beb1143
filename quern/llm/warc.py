"""WARC archives of pages and the merge of their sorted capture runs into one ordered index."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, written
from quern.sources.work import exists

#: Payloads of fewer bytes are always stored anew.
LEAST_REVISIT = 1000
END = "\r\n\r\n"
#: Bytes of an archive; captures of a range that one task merges.
MOST_BYTES = 64 << 20
MOST_ROWS = 50_000
CAPTURES = (
    "page_id long, url string, urlkey string, captured_at string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, archive string, record_offset long, record_length long, run_position long"
)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to of each page.

    Of pages with equal payloads of at least least bytes the one with the largest page_id is stored,
    the others refer to it. Null html is an empty payload. A page without page_id never stands for
    others; of repeated rows of the page that stands for a group, each is stored.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    groups = rows.where(f"payload_bytes >= {int(least)}").groupBy("payload_digest").agg(F.max("page_id").alias("stored"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and stored is not null").select("payload_digest", "stored"), "payload_groups")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("stored"))
    return rows.join(groups, "payload_digest", "left").withColumn("refers_to", F.when(other, F.col("stored"))).drop("stored")


def record_text():
    """One WARC record without its closing empty lines, from the columns of with_revisits and captured_at."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", F.col("captured_at")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", page("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block)


def capture_time():
    """The pages have no time of capture: one second a page_id from a fixed day on, within ten years."""
    second = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(315_360_000))
    return F.date_format(F.timestamp_seconds(second + F.lit(1_704_067_200)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Write a record for each page into archives at path; returns archive, records, bytes of each.

    A record is a gzip member of its own, so a reader can seek to it. An archive is closed once the
    next member would take it beyond most_bytes, so a longer member stands alone. It is written beside
    its place and moved there whole; a task that is run again has its rows in the same order and so
    replaces its archives by equal ones.
    """
    rows = with_revisits(pages).withColumn("captured_at", capture_time()).sortWithinPartitions("page_id", "url", "payload_digest")

    def store(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        part, done, stream, where, size, records = TaskContext.get().partitionId(), [], None, "", 0, 0

        def close():
            stream.close()
            name = f"captures-{part:06d}-{len(done):05d}.warc.gz"
            system.move(where, f"{folder}/{name}")
            done.append((name, records, size))

        for batch in batches:
            for record in batch.column(0).cast(pa.binary()):
                member = gzip.compress(record.as_py() + END.encode(), 6, mtime=0)
                if stream is not None and size + len(member) > most_bytes:
                    close()
                    stream = None
                if stream is None:
                    where, size, records = f"{folder}/.{uuid.uuid4().hex}", 0, 0
                    stream = system.open_output_stream(where)
                stream.write(member)
                size, records = size + len(member), records + 1
        if stream is not None:
            close()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    return written(rows.select(record_text().alias("value")).mapInArrow(store, "archive string, records long, bytes long"), "archives", 50)


def surt(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query; scheme, user, www and fragment go."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url.strip(), re.I)
    host, rest = (m[1], m[2]) if m else ("", url.split("#")[0])
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2].lower())
    host, _, port = host.partition(":")
    port = "" if port in ("", "80", "443") else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){rest or '/'}"


def members(file: io.BufferedIOBase, block: int = 1 << 20) -> Iterator[tuple[bytes, int, int]]:
    """Content, offset and length of each gzip member of an archive; one member at a time is held."""
    at, data = 0, file.read(block)
    while data:
        inflate, parts, length = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not data and not (data := file.read(block)):
                raise ValueError(f"member at {at} isn't whole")
            parts.append(inflate.decompress(data))
            length += len(data) - len(inflate.unused_data)
            data = inflate.unused_data
        yield b"".join(parts), at, length
        at += length
        data = data or file.read(block)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (with the payload's announced size as http-content-length) and payload of one record."""
    head, _, rest = record.partition(END.encode())
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no record")
    headers = {}
    for line in lines:
        name, _, value = line.decode("utf-8").partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    if rest[size:] != END.encode():
        raise ValueError("the record isn't closed")
    http, _, payload = rest[:size].partition(END.encode())
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    headers["http-content-length"] = length[1].decode() if length else str(len(payload))
    return headers, payload


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, archives: DataFrame | None = None) -> DataFrame:
    """The captures in the archives at path; each archive's are a run sorted by URL key, time and page.

    archives names those to read (column archive), as write_archives returns them: what a failed task
    left in the folder isn't read. Without it every archive in the folder is.

    Archives are streamed, one record held at a time. Digest and size come from a response's own payload
    and are checked against the header; a revisit holds no payload and states them. record_offset and
    record_length are the place of the record's member in its archive. No archive, no row.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], CAPTURES)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = [x.split()[0] for x in CAPTURES.split(", ")]
        kinds = [pa.string() if "string" in x else pa.int64() for x in CAPTURES.split(", ")]
        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{folder}/{archive}", compression=None) as file:
                    for record, at, size in members(file):
                        h, payload = parse_record(record)
                        digest, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["http-content-length"])
                        if h["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
                            raise ValueError(f"{archive} at {at}: payload and header differ")
                        url = h["warc-target-uri"]
                        rows.append((_page(h["warc-record-id"]), url, surt(url), h["warc-date"], h["warc-type"], _page(h.get("warc-refers-to")), length, digest, archive, at, size))
                rows = [(*r, i) for i, r in enumerate(sorted(rows, key=capture_order))]
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 5000]), kinds)], names=names)

    if archives is None:
        archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"))
    files = archives.select("archive")
    return written(files.mapInArrow(run, CAPTURES), "runs")


def capture_order(row: tuple):
    """URL key, time, page (none first), then the place in the archives."""
    page = row[0]
    return row[2], row[3], page is not None, page or 0, row[8], row[9]


class LoserTree:
    """Merge of sorted runs: each inner node keeps the loser of its match, so the next item costs one
    match a level on the way from the run that was drawn to the root."""

    def __init__(self, runs: list[Iterable], key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf)

    def _wins(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.tree[node] < 0:  # while building: wait here for the other side's winner
                self.tree[node] = winner
                return
            if self._wins(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[top := self.tree[0]] is not None:
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self.keys[top] = None if self.heads[top] is None else self.key(self.heads[top])
            self._play(top)


def merge_runs(captures: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """captures with position: their place (from 0) in the order of URL key, time and page.

    The runs are stored; ranges of the order, of about most_rows captures however many there are, are
    dealt to tasks, run by run, each run's part in its order. A range may begin within one URL's
    captures, so a URL with a third of all captures is spread too. In a task a loser tree merges the
    parts, which are all it holds.
    """
    names = captures.columns
    schema = f"{CAPTURES}, part int, nth long"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        runs: dict[str, list[tuple]] = {}
        arrow = None
        for batch in batches:
            arrow = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[8], []).append(row)
        part, merged, done = TaskContext.get().partitionId(), iter(LoserTree(list(runs.values()), capture_order)), 0
        while rows := [r for _, r in zip(range(5000), merged)]:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32()), pa.array(range(done, done + len(rows)), pa.int64())], names=[*names, "part", "nth"])
            done += len(rows)

    ranges = max(1, -(-captures.count() // most_rows))
    dealt = captures.repartitionByRange(ranges, "urlkey", "captured_at", "page_id", "archive", "record_offset")
    merged = written(dealt.sortWithinPartitions("archive", "run_position").mapInArrow(run, schema), "merged")
    sizes = sorted((r["part"], r["count"]) for r in merged.groupBy("part").count().collect())
    first, offsets = 0, []
    for part, n in sizes:  # a row a task
        offsets.append((part, first))
        first += n
    starts = captures.sparkSession.createDataFrame(offsets, "part int, first long")
    return merged.join(F.broadcast(starts), "part").withColumn("position", F.col("first") + F.col("nth")).drop("part", "nth", "first", "run_position")


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back and merge their runs; see the steps above."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archives")
    return merge_runs(read_archives(spark, path, write_archives(pages, path)))

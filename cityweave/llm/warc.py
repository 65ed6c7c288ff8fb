"""WARC archives of pages, with an externally merged capture index.

Each task writes one archive of gzip members and one run of index entries sorted by URL key and
timestamp. Runs are merged by loser trees, in rounds of bounded fan-in; in the last round every task
merges one range of keys of all runs, so the index is globally ordered without one task seeing it
all. Of records with equal payloads that of the smallest page is the response, others revisit it."""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import stage_root
from .common import broadcast_if_small, ready, stage, table

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)  # capture time of page 0; page n is n seconds later
FAN_IN = 64
ENTRIES = 4096  # index entries in a batch of a run
INDEX = pa.schema([("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()),
                   ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = "urlkey string, timestamp string, page_id long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query; no scheme, fragment or leading www."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").lower().removeprefix("www.")
        port = f":{u.port}" if u.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def capture_time(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page_id or 0) % (10 ** 10))


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, first: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit holds the HTTP header alone, with the length of the full payload."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
            f"WARC-Target-URI: {quote(url or 'urn:x-page:no-url', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{first}>"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """Header fields (lower case), HTTP fields below ``http``, and the payload of one member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


# ------------------------------------------------------------------ index runs -------------
class LoserTree:
    """The least of k sorted iterators, one comparison a level for each item taken."""

    def __init__(self, sources: list[Iterator]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.k = len(sources)
        self.losers = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._enter(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[:3] < y[:3] if x[:3] != y[:3] else a < b

    def _enter(self, leaf: int) -> None:
        """First ascent of a leaf: it waits at the first empty match."""
        node = (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = leaf
                return
            if self._before(other, leaf):
                self.losers[node], leaf = leaf, other
            node //= 2
        self.losers[0] = leaf

    def __iter__(self) -> Iterator:
        while self.k and self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.sources[winner], None)
            node = (winner + self.k) // 2
            while node > 0:
                if self._before(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def _sort_key(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2]


def _rows(batch: pa.RecordBatch, low: int = 0) -> Iterator[tuple]:
    """((urlkey, timestamp, page_id or -1), row) flattened so that the first three fields are the key."""
    for row in zip(*(batch.column(i).slice(low).to_pylist() for i in range(6))):
        yield (*_sort_key(row), row)


def read_run(path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """Entries of a run with low <= (urlkey, timestamp) < high, a batch at a time."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        run = ipc.open_file(f)
        a, b = 0, run.num_record_batches
        if low is not None:  # the first batch that may hold ``low`` is the one before the first that begins at or above it
            while a < b:
                mid = (a + b) // 2
                first = run.get_batch(mid)
                a, b = (mid + 1, b) if (first.column(0)[0].as_py(), first.column(1)[0].as_py()) < low else (a, mid)
            a = max(a - 1, 0)
        for i in range(a, run.num_record_batches):
            for row in _rows(run.get_batch(i)):
                if low is not None and row[:2] < low:
                    continue
                if high is not None and row[:2] >= high:
                    return
                yield row


def write_run(path: str, rows: Iterator[tuple]) -> int:
    """Write sorted index rows under an attempt's name, then rename; their number."""
    store, at = fs.FileSystem.from_uri(path)
    tried, n, held = f"{at}.{uuid.uuid4().hex}", 0, []
    with store.open_output_stream(tried) as sink, ipc.new_file(sink, INDEX) as f:
        def put() -> None:
            f.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), INDEX)], schema=INDEX))
        for row in rows:
            held.append(row)
            if len(held) == ENTRIES:
                put()
                n, held = n + len(held), []
        if held:
            put()
            n += len(held)
    store.move(tried, at)
    return n


def merge_runs(spark: SparkSession, root: str, runs: list[int], samples: DataFrame, ranges: int, fan_in: int = FAN_IN) -> DataFrame:
    """The index in order: partition r of the result is key range r, sorted. ``runs``: the numbers of
    the tasks that wrote a run."""
    level = 0
    while len(runs) > fan_in:
        groups = -(-len(runs) // fan_in)

        def narrow(batches: Iterator[pa.RecordBatch], level=level, runs=runs) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch.column("id").to_pylist():
                    parts = [read_run(f"{root}/run-{level}-{i:06d}.arrow") for i in runs[g * fan_in:(g + 1) * fan_in]]
                    n = write_run(f"{root}/run-{level + 1}-{g:06d}.arrow", (x[3] for x in LoserTree(parts)))
                    yield pa.RecordBatch.from_pydict({"n": [n]})

        stage(spark.range(0, groups, 1, groups).mapInArrow(narrow, "n long"), "warc-merge")
        level, runs = level + 1, list(range(groups))
    # boundaries from a bounded sample of the keys
    keys = [tuple(r) for r in samples.orderBy(F.xxhash64("urlkey", "timestamp")).limit(64 * ranges).collect()]
    keys = sorted(set(keys))
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    bounds = list(zip([None, *cuts], [*cuts, None]))

    def last(batches: Iterator[pa.RecordBatch], level=level, runs=runs) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column("id").to_pylist():
                held = []
                for row in LoserTree([read_run(f"{root}/run-{level}-{i:06d}.arrow", *bounds[r]) for i in runs]):
                    held.append(row[3])
                    if len(held) == ENTRIES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), INDEX)], schema=INDEX)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), INDEX)], schema=INDEX)

    return spark.range(0, len(bounds), 1, len(bounds)).mapInArrow(last, INDEX_DDL)


# ------------------------------------------------------------------ archives ---------------
def write(pages: DataFrame, root: str, min_revisit: int = 0) -> tuple[DataFrame, list[int]]:
    """Write archives and index runs below ``root``; (sampled index keys, numbers of the tasks
    that wrote a run).

    ``pages`` has page_id, url, html; a null html is an empty payload, a null url has the key "".
    Payloads of under ``min_revisit`` bytes are always responses. Rows of a null page_id revisit the
    smallest page of their payload; where no row has an id, each is a response. Repeated rows of the
    smallest page are all responses. Extra columns are ignored; an empty table makes no run."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    first = stage(p.groupBy("sha1", "size").agg(F.min("page_id").alias("first")), "warc-first")
    d = p.join(broadcast_if_small(first), ["sha1", "size"])
    revisit = (F.col("size") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    d = d.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "sha1", "first", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}"
        store, folder = fs.FileSystem.from_uri(root)
        entries, out, at = [], None, 0
        tried = f"{folder}/pages-{name}.warc.gz.{task.taskAttemptId()}"
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha1", "first", "revisit"))):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(tried)
                member = record(*row)
                out.write(member)
                entries.append((url_key(row[1]), f"{capture_time(row[0]):%Y%m%d%H%M%S}", row[0], f"pages-{name}.warc.gz", at, len(member)))
                at += len(member)
        if out is None:
            return
        out.close()
        store.move(tried, f"{folder}/pages-{name}.warc.gz")
        entries.sort(key=_sort_key)
        write_run(f"{root}/run-0-{name}.arrow", iter(entries))
        step = max(1, len(entries) // 64)
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "urlkey": [[e[0] for e in entries[::step]]], "timestamp": [[e[1] for e in entries[::step]]]})

    parts = stage(d.mapInArrow(run, "part long, urlkey array<string>, timestamp array<string>"), "warc-parts")
    numbers = sorted(r["part"] for r in parts.select("part").collect())  # one number a task that had rows
    samples = parts.select(F.explode(F.arrays_zip("urlkey", "timestamp")).alias("x")).select("x.urlkey", "x.timestamp")
    return samples, numbers


def read(index: DataFrame, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records the index names."""
    def number(urn: str) -> int | None:
        name = urn.strip("<>").rpartition(":")[2]
        return None if name == "none" else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        name, f = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    name, f = archive, store.open_input_file(f"{folder}/{archive}")
                f.seek(offset)
                r = parse(f.read(length))
                page, kind = number(r["warc-record-id"]), r["warc-type"]
                if kind == "revisit":
                    out.append((page, int(r["http"]["content-length"]), r["warc-payload-digest"].removeprefix("sha1:"), kind, number(r["warc-refers-to"])))
                else:
                    out.append((page, len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode(), kind, None))
            if out:
                a, b, c, d, e = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d), pa.array(e, pa.int64())],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    by_place = index.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset")
    return by_place.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def capture_index(pages: DataFrame, root: str, min_revisit: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Write ``pages`` as archives below ``root`` and return their capture index in global order of
    (urlkey, timestamp, page_id), with each record's archive, offset and length."""
    spark = pages.sparkSession
    samples, runs = write(pages, root, min_revisit)
    if not runs:
        return spark.createDataFrame([], INDEX_DDL)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stage(merge_runs(spark, root, runs, samples, ranges, fan_in), "warc-index")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    root = f"{stage_root(ready(spark))}/warc-{uuid.uuid4().hex}"
    return read(capture_index(table(spark, sf_dir, "pages"), root), root)


ORACLE_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h FROM p),
w AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast(((cast('0x' || substr(h, cast(i // 8 * 10 + 1 AS int), 10) AS bigint) >> cast(35 - 5 * (i % 8) AS int)) & 31) AS int), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM w"""

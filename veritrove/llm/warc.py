"""WARC archives: writing, reading, and a globally ordered capture index.

write_warc makes one gzip member for each record, response or revisit, and
read_warc parses the archives again. The index follows the external-merge
method: the captures of every archive are a run, sorted locally by (URL key,
timestamp, record id); a range partitioning by that key, whose bounds Spark
takes from a bounded sample, cuts every run; each range merges its slices of
all runs with a loser tree, and the ranges in order are the capture history of
every URL.

A capture whose payload (of at least `min_bytes`) equals that of a smaller id
is a revisit of the smallest.

Archives end at about ARCHIVE_BYTES and are read as streams, a range has about
RANGE_ROWS captures, and the index lines of one archive or range are all that a
task holds.

Defined cases: a null payload is empty; a null URL has the key ''; equal URLs
and timestamps are ordered by id; rows that share the smallest id are all
responses, and so are rows without an id, to which nothing refers and which
come first among equal keys; a time outside of the years 1 to 9999 is the
nearest one inside; an empty table gives an empty index; other columns are not
read. The range key includes the id, so one URL or host that holds most
captures still spreads over ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timedelta, timezone
from itertools import chain, islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, shared_dir, stored
from .tokens import filesystem

#: The default capture time of id k is this plus (k mod 2^31) seconds.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Captures of one range of the index.
RANGE_ROWS = 50_000
#: A table of repeated payloads up to this many rows (of some 60 bytes) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def url_key(url: str | None) -> str:
    """The sort-friendly form: host labels reversed and joined by commas, then ')' and the path with its query, lower-cased."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    if len(labels) > 1 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    default = {"http": 80, "https": 443}.get(parts.scheme)
    tail = f":{port}" if port and port != default else ""
    path = re.sub(r"/+$", "", parts.path) or "/"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(labels))}{tail}){path}{query}".lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def moment(seconds: int | None) -> datetime:
    """Seconds since 1970 as a time of the years 1 to 9999."""
    start, zero = datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(1, 1, 1, tzinfo=timezone.utc)
    least, most = -((start - zero) // timedelta(seconds=1)), (datetime(9999, 12, 31, 23, 59, 59, tzinfo=timezone.utc) - start) // timedelta(seconds=1)
    return start + timedelta(seconds=min(max(seconds or 0, least), most))


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, when: datetime) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    stamp = when.replace(tzinfo=None).isoformat(timespec="seconds") + "Z"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{page_id}')}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Date: {stamp}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if page_id is not None:
        head.append(f"X-Capture-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{refers_to}')}>", f"X-Refers-To-Capture: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(stream, chunk: int = 1 << 20):
    """(offset, length, headers, block) of each gzip member of an archive, read piece by piece."""
    at, data = 0, b""
    while data or (data := stream.read(chunk)):
        one, parts, length = zlib.decompressobj(31), [], 0
        while not one.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("an archive ends inside a record")
            parts.append(one.decompress(data))
            length += len(data) - len(one.unused_data)
            data = one.unused_data
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        yield at, length, headers, rest[: int(headers["Content-Length"])]
        at += length


def with_origins(pages: DataFrame, id_column: str, payload_column: str, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to: for all but the smallest id of equal payloads, that id.

    Digests are grouped with partial aggregation, so a payload that holds most
    rows costs a row for each task. Groups of several are written and counted;
    up to BROADCAST_ROWS of them are broadcast, so that payloads stay where
    they are, and more are joined by digest.
    """
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    keyed = pages.withColumn("_sha", F.sha1(payload.cast("binary"))).withColumn("_len", F.octet_length(payload))
    first = (
        keyed.where(F.col("_len") >= min_bytes).groupBy(F.col("_sha").alias("_s"), F.col("_len").alias("_l"))
        .agg(F.min(id_column).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    first = stored(first, "repeated")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    joined = keyed.join(first, (F.col("_sha") == F.col("_s")) & (F.col("_len") == F.col("_l")), "left")
    return joined.withColumn("refers_to", F.when(F.col("_first") != F.col(id_column), F.col("_first"))).drop("_sha", "_len", "_s", "_l", "_first")


def write_warc(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
               time_column: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes <folder>/<name>.warc.gz, one or more files for each partition; returns (file, records)."""
    when = F.unix_timestamp(time_column) if time_column else F.pmod(F.col(id_column).cast("bigint"), F.lit(1 << 31)) + int(EPOCH.timestamp())
    rows = with_origins(pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url"), F.col(payload_column).alias("payload"), when.alias("at")), "page_id", "payload", min_bytes)

    def archived(fs, root, captures):
        """One archive of captures, as many as fit; its name and their number."""
        name, n, size = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
        with fs.open_output_stream(f"{root}/_{name}", compression=None) as out:
            for page, url, at, first, body in captures:
                out.write(record(page, url, body, digest(body), first, moment(at)))
                n, size = n + 1, size + len(body)
                if size >= archive_bytes:
                    break
        fs.move(f"{root}/_{name}", f"{root}/{name}")
        return name, n

    def captures_of(batches):
        for batch in batches:
            payloads = batch.column(2).cast(pa.large_binary())
            for i, (page, url, at, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                yield page, url, at, first, payloads[i].as_py() or b""

    def run(batches):
        fs, root = filesystem(folder)
        captures = captures_of(batches)
        for one in captures:
            fs.create_dir(root, recursive=True)
            name, n = archived(fs, root, chain([one], captures))
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    rows.select("page_id", "url", "payload", "at", "refers_to").mapInArrow(run, "file string, records bigint").write.parquet(f"{folder}/files")
    return pages.sparkSession.read.schema("file string, records bigint").parquet(f"{folder}/files")


CAPTURE = pa.schema([
    ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
CAPTURE_DDL = "url_key string, timestamp string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"
KEY = ("url_key", "timestamp", "page_id")


def capture(file: str, offset: int, length: int, headers: dict, block: bytes) -> dict:
    """An index line from a record; payloads that are there are measured and hashed anew."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["WARC-Type"]
    if kind == "response":
        size, sha1 = len(payload), digest(payload)
        if f"sha1:{sha1}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"{file}: the payload at {offset} doesn't match its digest")
    else:
        size, sha1 = int(re.search(rb"Content-Length: (\d+)", http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    refers, page = headers.get("X-Refers-To-Capture"), headers.get("X-Capture-ID")
    return dict(zip(CAPTURE.names, (
        url_key(headers["WARC-Target-URI"]), re.sub(r"\D", "", headers["WARC-Date"]), int(page) if page else None, headers["WARC-Target-URI"], size, sha1, kind,
        int(refers) if refers else None, file, offset, length), strict=True))


class LoserTree:
    """Merges sorted runs; each step replays one path of the tree."""

    def __init__(self, runs, key):
        self.sources = [iter(r) for r in runs]
        self.key = key
        self.k = max(1, len(self.sources))
        self.heads = [self._next(i) for i in range(len(self.sources))] or [None]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(len(self.heads)):
            self._replay(i)

    def _next(self, i: int):
        item = next(self.sources[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a comes before run b; an exhausted run never does."""
        if self.heads[a] is None:
            return False
        return self.heads[b] is None or self.heads[a][:2] < self.heads[b][:2]

    def _replay(self, i: int) -> None:
        """Takes run i from its leaf to the root; while the tree is filled, a path ends at the first free node."""
        node = (i + self.k) // 2
        while node:
            if self.losers[node] == -1:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i

    def __iter__(self):
        while self.winner >= 0 and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            self._replay(i)


def in_order(url_key: str, timestamp: str, page_id: int | None) -> tuple:
    """A capture's key; no id comes before any."""
    return url_key, timestamp, page_id is not None, page_id or 0


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """The captures of every archive; each archive is one run, sorted by key: columns run, place and the index line."""
    n = max(1, min(files.count(), 10_000))

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, root = filesystem(folder)
                with fs.open_input_stream(f"{root}/{file}", compression=None) as f:
                    lines = sorted((capture(file, *r) for r in records(f)), key=lambda c: in_order(*(c[k] for k in KEY)))
                for a in range(0, len(lines), 10_000):
                    part = lines[a : a + 10_000]
                    t = pa.Table.from_pylist(part, CAPTURE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(part)), pa.array(range(a, a + len(part)), pa.int64()), *[c.combine_chunks() for c in t.columns]], names=["run", "place", *CAPTURE.names])

    return files.select("file").repartition(n).mapInArrow(run, f"run string, place bigint, {CAPTURE_DDL}")


def merged(runs: DataFrame, ranges: int) -> DataFrame:
    """The global capture history: range after range, each merged from its slice of every run."""

    def merge(batches):
        table = pa.Table.from_batches(batches, schema) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        run = table["run"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place = table["place"].to_numpy()
        by_run = np.lexsort((place, run))  # a shuffle delivers the blocks of runs in any order
        cuts = np.flatnonzero(np.diff(run[by_run])) + 1
        keys = [in_order(*k) for k in zip(*(table[c].to_pylist() for c in KEY), strict=True)]
        order = iter(LoserTree([s.tolist() for s in np.split(by_run, cuts)], key=keys.__getitem__))
        lines, here, at = table.select(CAPTURE.names), TaskContext.get().partitionId(), 0
        while part := list(islice(order, 10_000)):
            some = lines.take(pa.array(part)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array([here] * len(part), pa.int32()), pa.array(range(at, at + len(part)), pa.int64()), *some.columns], names=["range", "place", *CAPTURE.names])
            at += len(part)

    schema = pa.schema([("run", pa.string()), ("place", pa.int64()), *CAPTURE])
    return runs.repartitionByRange(ranges, *KEY).mapInArrow(merge, f"range int, place bigint, {CAPTURE_DDL}")


def capture_index(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the pages' archives (to a new shared folder, unless one is given) and returns their capture history.

    Columns: history (the capture's place in the global order), then the index line.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc"
    range_rows = options.pop("range_rows", RANGE_ROWS)
    files = write_warc(pages, folder, **options)
    n = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    runs = stored(read_warc(files, folder), "runs")
    lines = stored(merged(runs, max(1, -(-n // range_rows))), "index")
    discard(runs)
    # One row for each range, so a window over all of them is small.
    bases = lines.groupBy("range").agg(F.count(F.lit(1)).alias("_n"))
    bases = bases.select(F.col("range").alias("_range"), (F.sum("_n").over(Window.orderBy("range")) - F.col("_n")).alias("_base"))
    return lines.join(bases, F.col("range") == F.col("_range")).select((F.col("_base") + F.col("place")).alias("history"), *CAPTURE.names)


__all__ = ["LoserTree", "capture_index", "merged", "read_warc", "url_key", "with_origins", "write_warc"]

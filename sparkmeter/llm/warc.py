"""WARC archives of pages, their local capture indexes, and the merge of these into one ordered index.

Each task writes the records of its rows to one archive of gzip members and, beside it, the run of its captures
sorted by URL key, timestamp and page. The runs are cut at the same keys into ranges of bounded size, and in each range
the pieces of all runs are merged by a tree of losers, so the ranges in turn are the globally ordered index.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import folder, save

#: Payloads from this size on are written once; later equal ones become revisits.
LEAST_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
RANGE_CAPTURES = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the lower-case path and query: one site's captures lie together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:  # not a URL that can be taken apart
        return (url or "").strip().lower()
    labels = ",".join(reversed([x for x in re.sub(r"^www\d*\.", "", host).split(".") if x]))
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''})" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def stamp(page_id: int | None) -> str:
    """The tables have no capture times; a page's number of seconds after 2020 stands for one."""
    import datetime as dt

    at = dt.datetime(2020, 1, 1) + dt.timedelta(seconds=(page_id or 0) % (10**9))
    return at.strftime("%Y%m%d%H%M%S")


def with_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, refers_to): null refers_to for responses.

    Payloads are the html in UTF-8 (null: empty). Of equal payloads of LEAST_BYTES and more, the largest page_id
    is the response (null ids last; of rows with that same id, all are). Maxima of a digest are combined before
    the shuffle, and only digests seen twice are joined back, so a payload on a third of all pages is no hot key.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    large = F.col("payload_bytes") >= LEAST_BYTES
    seen = rows.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    seen = save(seen.where("n > 1").select(F.col("payload_digest").alias("of"), "first_id"), "responses")
    joined = rows.join(seen, large & (F.col("payload_digest") == F.col("of")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.withColumn("refers_to", refers).drop("of", "first_id")


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id, url, body: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: an HTTP response, whose body a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if refers_to is None else http
    when = stamp(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_uri(page_id)}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}", f"WARC-Date: {when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:]}Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_uri(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, name, at, run_ = None, "", 0, []

        def close():
            run_.sort(key=lambda c: c[:3])
            lines = b"".join(json.dumps(c).encode() + b"\n" for c in run_)
            with store.open_output_stream(f"{base}/{name}.cdx") as f:
                f.write(lines)
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "captures": [len(run_)], "bytes": [at]})

        for b in batches:
            for row in b.to_pylist():
                if out is None:  # a task that is run again writes other files; only those that Spark commits are read
                    name, at, run_ = uuid.uuid4().hex, 0, []
                    out = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
                member = _packed(record(row["page_id"], row["url"], row["html"].encode(), row["payload_digest"], row["refers_to"]))
                out.write(member)
                run_.append((url_key(row["url"]), stamp(row["page_id"]), -1 if row["page_id"] is None else row["page_id"], name, at, len(member)))
                at += len(member)
                if at >= limit:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """The folder of the archives, and (archive, captures, bytes) of each. Archives end at about `archive_bytes`."""
    path = folder(pages.sparkSession, "warc")
    made = with_records(pages).mapInArrow(_writer(path, archive_bytes), "archive string, captures long, bytes long")
    return path, save(made, "archives")


class LoserTree:
    """k-way merge of sorted iterators; a step costs one comparison for each level of the tree."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * k
        self.winner = -1
        for i in range(k):
            self._play(i, building=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and x is not None or x is not None and (x, a) < (y, b)

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._play(self.winner)


def _captures(path: str):
    """The runs beside the archives, line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}.cdx") as f:
                    rest, n = b"", 0
                    while piece := f.read(1 << 20):
                        *whole, rest = (rest + piece).split(b"\n")
                        rows = [(*json.loads(x), n + i) for i, x in enumerate(whole)]
                        n += len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, _TYPES)], _NAMES)

    return run


_NAMES = ["url_key", "stamp", "page_id", "archive", "at", "bytes", "place"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
_CAPTURE = "url_key string, stamp string, page_id long, archive string, at long, bytes long, place long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: the pieces of all runs that lie in it, each in its order, become one piece."""
    from itertools import groupby, islice

    from pyspark import TaskContext

    runs = [list(g) for _, g in groupby((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: r[3])]
    merged, n, part = iter(LoserTree([iter(r) for r in runs])), 0, TaskContext.get().partitionId()
    while rows := list(islice(merged, 5_000)):
        cols = [pa.array(c, t) for c, t in zip(list(zip(*rows))[:6], _TYPES)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(rows), pa.int32()), pa.array(range(n, n + len(rows)), pa.int64())], [*_NAMES[:6], "part", "place"])
        n += len(rows)


def merged_index(path: str, archives: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """(url_key, stamp, page_id, archive, at, bytes, part, place): all captures, in the order of (part, place).

    The order is URL key, timestamp, page. Key ranges are cut by all three, so the captures of one URL, however
    many, are spread over tasks; a range holds about `range_captures`. Within a range the runs' pieces are merged by
    a tree of losers. Pages without an id have -1 here.
    """
    total = archives.agg(F.sum("captures")).first()[0] or 0
    runs = archives.select("archive").repartition(max(1, min(archives.count(), 10_000))).mapInArrow(_captures(path), _CAPTURE)
    dealt = runs.repartitionByRange(max(1, -(-total // range_captures)), "url_key", "stamp", "page_id").sortWithinPartitions("archive", "place")
    return save(dealt.mapInArrow(_merge, _CAPTURE.replace("place long", "part int, place long")), "index")


def parse(raw: bytes) -> dict:
    """Headers and payload facts of one record; the payload of a response must have the digest that its header says."""
    head, _, block = raw.partition(b"\r\n\r\n")
    said = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, body = block[: int(said["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = said["WARC-Payload-Digest"].removeprefix("sha1:")
    if said["WARC-Type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"{said['WARC-Record-ID']} is damaged")
    number = lambda uri: int(x) if (x := uri.strip("<>").removeprefix("urn:page:")) else None
    return {
        "page_id": number(said["WARC-Record-ID"]), "url": said["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "record_type": said["WARC-Type"], "refers_to": number(said["WARC-Refers-To"]) if "WARC-Refers-To" in said else None, "payload": body,
    }


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        name, f = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["archive"] != name:
                    if f:
                        f.close()
                    name, f = r["archive"], store.open_input_file(f"{base}/{r['archive']}.warc.gz")
                f.seek(r["at"])
                found = parse(zlib.decompress(f.read(r["bytes"]), 31))
                del found["payload"]
                rows.append(found)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if f:
            f.close()

    return run


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(path: str, index: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records an index names.

    An archive is read from front to back in one task; archives have a size limit, and so has a task's work.
    """
    tasks = max(1, min(index.select("archive").distinct().count(), 10_000))
    return index.select("archive", "at", "bytes").repartition(tasks, "archive").sortWithinPartitions("archive", "at").mapInArrow(_reader(path), _READ)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """Pages (page_id, url, html) to archives, their runs to one index, and the records back through that index.

    One row for each row of pages; null html is an empty payload, a null or odd URL is kept as text ('' for null),
    other columns are not looked at.
    """
    path, archives = write_archives(pages, archive_bytes)
    return read_captures(path, merged_index(path, archives, range_captures))

"""WARC archives of pages and their external index.

A record is written for each page and the archives are read back.  Every archive gives a capture
run sorted by URL key and timestamp, which is stored.  Stored runs are cut at common range bounds, as they
lie, and each range streams its cuts through a loser tree, so that the index is in global order range
after range and nothing is sorted twice.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import lean, new_folder, written

#: Bytes of records after which a task begins another archive; one is read as a whole.
ARCHIVE_BYTES = 16_000_000
#: Rows of a range of the index; of every so many rows of a run one is a mark, and range bounds are chosen from so many marks at most.
RANGE_ROWS, MARK_ROWS, MARKS = 50_000, 1000, 1_000_000
#: Repeated digests that are broadcast, at most (some 100 bytes each); more of them are joined.
REPEATED = 400_000
#: Pages bear no capture time: a page's is its number of seconds after this.
FIRST_CAPTURE = datetime(2024, 1, 1)
#: Ends each record; the text writer puts it after each row.
END = "\r\n\r\n"
MAX_SECONDS = 200 * 365 * 86_400


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captured(page_id: int | None) -> datetime:
    return FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % MAX_SECONDS)


def url_key(url: str) -> str:
    """Host labels reversed, without scheme, 'www.', default port and fragment, in lower case; then path and query."""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return (key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _one_line(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None) -> bytes:
    """A WARC record without its end: a response, or a revisit of the page ``keeper``."""
    response = page_id == keeper
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    head = ["WARC/1.0", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {captured(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if not response:
        head += [f"WARC-Refers-To: <urn:page:{keeper}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def write_archives(pages: DataFrame) -> str:
    """Writes gzipped WARC archives of ``pages`` (page_id, url, html) and returns their folder.

    Of pages with equal payloads (a null html is an empty payload) the one with the largest
    page_id is a response and the others revisit it; repeated rows of that page are responses
    too.  A null page_id counts as the smallest.  A payload of any length is one record; only the three columns are read.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    repeated = written(rows.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"), "keepers")
    few = repeated.count() <= REPEATED

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = size = 0
        for batch in batches:
            ids, urls, pages_, keep = (batch.column(k).to_pylist() for k in range(4))
            out, archives = [], []
            for page_id, url, html, keeper in zip(ids, urls, pages_, keep, strict=True):
                made = record(page_id, url, html.encode(), keeper)
                archive, size = (archive + 1, 0) if size and size + len(made) > ARCHIVE_BYTES else (archive, size)
                size += len(made)
                out.append(made.decode())
                archives.append(archive)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(archives, pa.int32())], names=["value", "archive"])

    folder = new_folder(spark, "warc")
    # A page whose payload no other has is its own keeper, so pages stay where they are unless very many payloads repeat.
    made = rows.join(F.broadcast(repeated) if few else repeated, "sha", "left").select("page_id", "url", "html", F.coalesce("keeper", "page_id").alias("keeper")).mapInArrow(lean(build), "value string, archive int")
    made.write.partitionBy("archive").option("lineSep", END).option("compression", "gzip").text(folder)
    return folder


_HEAD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def records(raw: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """(offset, length, headers, block) of the records of an archive."""
    at, size = 0, len(raw)
    while at < size:
        if raw[at : at + 10] != b"WARC/1.0\r\n":
            raise ValueError(f"no record begins at {at}")
        stop = raw.index(b"\r\n\r\n", at) + 2
        head = {m[1].lower(): m[2] for m in _HEAD.finditer(raw, at + 10, stop)}
        begin = stop + 2
        end = begin + int(head[b"content-length"])
        if raw[end : end + 4] != END.encode():
            raise ValueError(f"the record at {at} doesn't end where it should")
        yield at, end + 4 - at, head, raw[begin:end]
        at = end + 4


def _page(raw: bytes) -> int | None:
    name = raw.removeprefix(b"<urn:page:").removesuffix(b">")
    return None if name == b"None" else int(name)


CAPTURE = T.StructType([T.StructField(n, t) for n, t in (("url_key", T.StringType()), ("captured", T.StringType()), ("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("archive", T.StringType()), ("record_offset", T.LongType()), ("record_length", T.LongType()))])
_ARROW = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
#: A run, or a cut of one: each column of its captures as an array, in the run's order.
RUN = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in CAPTURE.fields])
_MARK = T.ArrayType(T.StructType(CAPTURE.fields[:3]))


def _order(row: tuple) -> tuple:
    return *_key(row), row[8], row[9]


def _key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _to_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def capture_runs(spark, folder: str) -> DataFrame:
    """(captures, marks, and RUN's columns): a sorted run of captures for each archive under ``folder``.

    A response's digest is checked against its payload.  record_offset is the place in the archive's
    uncompressed bytes; marks are the keys of the run's first capture and every MARK_ROWS-th one after it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    schema = T.StructType([T.StructField("captures", T.LongType()), T.StructField("marks", _MARK), *RUN.fields])
    mark = pa.list_(pa.struct([(f.name, t) for f, t in zip(CAPTURE.fields[:3], _ARROW, strict=False)]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, rows = batch.column(0)[k].as_py(), []
                for at, length, head, block in records(gzip.decompress(batch.column(1)[k].as_py())):
                    stop = block.index(b"\r\n\r\n") + 4
                    n = int(next(m[2] for m in _HEAD.finditer(block, 0, stop) if m[1].lower() == b"content-length"))
                    kind, sha = head[b"warc-type"].decode(), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    if kind == "response" and (len(block) - stop != n or digest(block[stop:]) != sha):
                        raise ValueError(f"the payload of the record at {at} of {path} is damaged")
                    url = head[b"warc-target-uri"].decode()
                    date = re.sub(rb"\D", b"", head[b"warc-date"]).decode()
                    refers = _page(head[b"warc-refers-to"]) if kind == "revisit" else None
                    rows.append((url_key(url), date, _page(head[b"warc-record-id"]), url, n, sha, kind, refers, path, at, length))
                rows.sort(key=_order)
                marks = [dict(zip(CAPTURE.names, r, strict=False)) for r in rows[::MARK_ROWS]]
                columns = [pa.array([[r[c] for r in rows]], pa.list_(t)) for c, t in enumerate(_ARROW)]
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([marks], mark), *columns], names=schema.names)

    return files.mapInArrow(lean(parse), schema)


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so a new row replays one path."""

    def __init__(self, runs: list[Iterator[tuple[tuple, tuple]]]):
        self.runs, k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.tree = [-1] * max(k, 1)
        for i in range(k):
            self._enter(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _enter(self, i: int) -> None:
        """Fills the tree: a run waits at the first empty node, else plays on with the winner."""
        node = (i + len(self.runs)) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._less(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while (top := self.head[win := self.tree[0]]) is not None:
            yield top[1]
            self.head[win] = next(self.runs[win], None)
            i, node = win, (win + len(self.runs)) // 2
            while node:
                if self._less(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.tree[0] = i


def range_bounds(runs: DataFrame, range_rows: int) -> list[tuple]:
    """First keys of the ranges but the first, from a bounded sample of the runs' marks."""
    n = -(-(runs.agg(F.sum("captures")).first()[0] or 0) // range_rows)
    if n < 2:
        return []
    marks = runs.select(F.explode("marks").alias("m")).orderBy(F.xxhash64("m")).limit(MARKS).select("m.*")
    keys = sorted(_key(tuple(r)) for r in marks.collect())
    return sorted({keys[len(keys) * k // n] for k in range(1, n)})


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The runs as one index, in global order of (range_no, range_pos).

    Range bounds are over URL key, time and page, so that a URL with very many captures spans
    several ranges; a task holds one range's cuts.
    """
    kept = written(runs, "capture_runs")
    spark = kept.sparkSession
    bounds = range_bounds(kept, range_rows)
    shared = spark.sparkContext.broadcast(bounds)
    cuts = T.StructType([T.StructField("range_no", T.IntegerType()), *RUN.fields])
    schema = T.StructType([*CAPTURE.fields, T.StructField("range_no", T.IntegerType()), T.StructField("range_pos", T.LongType())])
    types = [*_ARROW, pa.int32(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = [batch.column(c)[k].values for c in range(len(CAPTURE))]
                keys = [_key(x) for x in zip(*(c.to_pylist() for c in columns[:3]), strict=True)]
                ranges, edges, at = [], [0], 0
                while at < len(keys):  # where the run's own keys pass a bound
                    no = bisect.bisect_right(shared.value, keys[at])
                    at = bisect.bisect_left(keys, shared.value[no], at) if no < len(shared.value) else len(keys)
                    ranges.append(no)
                    edges.append(at)
                offsets = pa.array(edges, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *(pa.ListArray.from_arrays(offsets, c) for c in columns)], names=cuts.names)

    def merged(no: int, own: list[tuple]) -> Iterator[pa.RecordBatch]:
        streams = [((_order(row), row) for row in zip(*(c.values.to_pylist() for c in columns), strict=True)) for columns in own]
        out, at = [], 0
        for row in LoserTree(streams):
            out.append((*row, no, at))
            at += 1
            if len(out) == 10_000:
                yield _to_batch(out, schema.names, types)
                out = []
        if out:
            yield _to_batch(out, schema.names, types)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                no = batch.column(0)[k].as_py()
                if no != now and own:
                    yield from merged(now, own)
                    own = []
                now = no
                own.append(tuple(batch.column(1 + c)[k] for c in range(len(CAPTURE))))
        if own:
            yield from merged(now, own)

    pieces = kept.select(*RUN.names).mapInArrow(lean(cut), cuts)
    return pieces.repartition(len(bounds) + 1, "range_no").sortWithinPartitions("range_no").mapInArrow(lean(merge), schema)


def archive_index(pages: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and merges their runs; a row for each row of ``pages``."""
    return merge_runs(capture_runs(pages.sparkSession, write_archives(pages)), range_rows)

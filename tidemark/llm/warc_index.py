"""WARC archives with an index written first, and reads by coalesced byte ranges.

`write_archives` writes one gzip member per record and returns the index: archive, offset, length, url, digest and kind of each record.
`read_records` takes any selection of index rows, sorts their ranges within each archive, joins ranges that lie at most `max_gap` bytes
apart into one read of at most `max_read` bytes (a single longer record is read whole), and parses what it read.

Pages of equal payloads of at least `min_revisit` bytes: the largest page_id is the response, the others are revisits of it. Rows that
repeat that page_id and payload are responses too. A revisit names its response by address and date, for a repeated response has several records. A null html is an empty payload; a null url is written as urn:page:<id>; a page
without id never is a revisit's target. Extra columns are ignored. Archives are written through pyarrow's file systems below the shared
folder; a task that fails leaves a file that no index names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, materialise

INDEX = "page_id long, url string, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


#: Copies of a payload from which its pages meet its target by a broadcast table, which has at most one row for as many pages.
HOT, BROADCAST_ROWS = 100_000, 1_000_000
#: Archive bytes that one task reads.
READ_BYTES = 32 << 20


def mark_revisits(pages: DataFrame, min_revisit: int = 1000, hot: int = HOT) -> DataFrame:
    """page_id, url, html, refers_to and refers_to_url (null for responses).

    Digests are grouped and joined without the pages. The pages meet only the list of revisits, by page_id and digest: Spark broadcasts it
    while it is small, and no key of it is hot. Payloads of very many copies meet their target by a broadcast.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumn("digest", F.when(F.octet_length("html") >= min_revisit, F.sha1(F.encode("html", "UTF-8"))))
    light = materialise(keyed.where(F.col("digest").isNotNull()).groupBy("page_id", "digest").agg(F.min("url").alias("url"), F.count("*").alias("n")), "digests")
    groups = light.groupBy("digest").agg(F.max_by(F.struct("page_id", "url"), "page_id").alias("target"), F.sum("n").alias("copies"))
    groups = materialise(groups.where((F.col("copies") > 1) & F.col("target").isNotNull()), "equal-payloads")
    many = groups.where(F.col("copies") > hot).drop("copies")
    if many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    rows = light.select("page_id", "digest")
    revisits = rows.join(groups.where(F.col("copies") <= hot).drop("copies"), "digest").unionByName(rows.join(many, "digest"))
    revisits = revisits.where(~F.col("page_id").eqNullSafe(F.col("target.page_id")))
    found = revisits.select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("target.page_id").alias("refers_to"), F.col("target.url").alias("refers_to_url"))
    marked = keyed.join(found, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")
    return marked.select("page_id", "url", "html", "refers_to", "refers_to_url")


def _uri(page_id: int | None, url: str | None) -> str:
    name = "" if page_id is None else str(page_id)
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", f"urn:page:{name}" if url is None else url)


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_to_url: str | None, date: str, place: str) -> tuple[bytes, str]:
    digest = hashlib.sha1(payload)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(page_id, url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest.digest()).decode()),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _uri(refers_to, refers_to_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(refers_to))]
    block = HTTP + (payload if refers_to is None else b"")
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n", digest.hexdigest()


def write_archives(marked: DataFrame, path: str, archive_bytes: int = 128 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the records of `mark_revisits` below path and return their index, itself written as Parquet before anything is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_to_url"))):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = r[2].encode()
                    raw, digest = _record(r[0], r[1], payload, r[3], r[4], date, f"{name}:{at}")
                    member = gzip.compress(raw, 5, mtime=0)
                    out.write(member)
                    rows.append((r[0], r[1], f"{path}/{name}", at, len(member), "response" if r[3] is None else "revisit", len(payload), digest, r[3]))
                    at += len(member)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    return materialise(map_batches(marked.select("page_id", "url", "html", "refers_to", "refers_to_url"), run, INDEX), "warc-index")


def ranges(selected: DataFrame, max_gap: int = 64 << 10, max_read: int = 8 << 20) -> DataFrame:
    """One row per read: archive, first byte, end, and the (offset, length) of its records in order."""
    by = Window.partitionBy("archive").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by)
    crosses = F.floor(F.col("offset") / max_read) != F.floor(F.lag("offset").over(by) / max_read)
    runs = selected.select("archive", "offset", "length").distinct().withColumn("new", F.when(gap.isNull() | (gap > max_gap) | crosses, 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(by))
    return runs.groupBy("archive", "run").agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    stated = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, target, size = h["WARC-Type"], None, int(h["X-Payload-Length"])
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != stated or len(payload) != size:
            raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
    else:
        target = int(h["X-Refers-To-Page-Id"])
    return int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], kind, size, stated, target, payload.decode() if kind == "response" else None


def read_records(selected: DataFrame, with_payload: bool = True, max_gap: int = 64 << 10, max_read: int = 8 << 20, task_bytes: int = READ_BYTES) -> DataFrame:
    """The parsed records of the selected index rows, in tasks of about `task_bytes` of archive. A revisit's digest and length are those of the full payload; its payload is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for archive, first, end, records in zip(*(batch.column(c).to_pylist() for c in ("archive", "first", "end", "records"))):
                store, name = fs.FileSystem.from_uri(archive)
                with store.open_input_file(name) as f:
                    data = f.read_at(end - first, first)
                rows = [_parse(zlib.decompress(data[r["offset"] - first : r["offset"] - first + r["length"]], 31)) for r in records]
                if not with_payload:
                    rows = [(*r[:-1], None) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    reads = ranges(selected, max_gap, min(max_read, task_bytes)).repartition(max(1, -(-size // task_bytes)), "archive", "first")
    return map_batches(reads, run, RECORD)

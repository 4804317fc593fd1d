"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit, where another capture has
the payload) and a metadata record.  Request and metadata name the record they
belong to by WARC-Concurrent-To.  Each record is a gzip member of its own, as
usual for WARC 1.1, and archives have a bounded size.

``assemble`` joins records through their concurrent-to identifiers, directly
or through one other record, into one nested row per response or revisit.

Defined results: a null payload is empty; of pages with equal payloads of at
least ``min_revisit`` bytes the greatest id is the response (all rows of that
id, if the row is repeated) and the others revisit it; a null id is below all
others, and one that is no whole number is an error; a null URL leaves the
target out; an empty table gives no archive; extra columns are never read.  A
payload is never split: a task holds one batch and one archive.  A
request or metadata record that names no known capture is dropped by
``assemble``; a capture without one has null there.  Retries write other file
names, and only files in the manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import files
from weft.llm.textops import modest_batches, tidy
from weft.shared import fresh_path, materialise

#: Compressed bytes from which an archive is closed, and records in a batch of rows read.
ARCHIVE_BYTES = 32 << 20
BATCH_RECORDS = 500
PIECE = 1 << 13
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        # Members are inflated piece by piece: what follows a member is copied once, not once a member.
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("archive is cut short")
            parts.append(z.decompress(view[at : at + PIECE]))
            at += min(PIECE, len(view) - at)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, rest[: int(headers["content-length"])]


def _one_line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def _capture(key: str | None, url: str | None, payload: bytes, revisit_of: str | None, date: str) -> bytes:
    """The members of one capture."""
    ids = [f"<urn:uuid:{uuid.uuid4()}>" for _ in range(3)]
    digest = digest_of(payload)
    target = [("WARC-Target-URI", _one_line(url))] if url is not None else []
    common = [("WARC-Date", date), *target]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = [("WARC-Record-ID", ids[0]), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit_of is None:
        first = record("response", main, http + payload)
    else:
        first = record("revisit", [*main, ("WARC-Profile", PROFILE)], http)
    ask = f"GET {_one_line(url or '/')} HTTP/1.1\r\nUser-Agent: weft\r\n\r\n".encode()
    second = record("request", [("WARC-Record-ID", ids[1]), *common, ("WARC-Concurrent-To", ids[0]), ("Content-Type", "application/http; msgtype=request")], ask)
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", key), ("refers-to-page", revisit_of)) if v is not None).encode()
    third = record("metadata", [("WARC-Record-ID", ids[2]), *common, ("WARC-Concurrent-To", ids[1]), ("Content-Type", "application/warc-fields")], fields)
    return first + second + third


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one capture per page below folder; the manifest (path, records), checkpointed.

    Payloads that occur once are never looked up in full: only digests held by
    two rows or more are joined back, and Spark splits a digest of many rows.
    """
    spark = pages.sparkSession
    modest_batches(spark, 1024)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload")).where(F.length("payload") >= min_revisit)
    shared = digests.groupBy(F.sha1("payload").alias("d")).agg(F.max("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1 and leader is not null").select("d", "leader")
    marked = rows.withColumn("own", F.when(F.length("payload") >= min_revisit, F.sha1("payload"))).join(shared, F.col("own") == F.col("d"), "left")
    revisit = F.when(F.col("leader").isNotNull() & ~F.col("leader").eqNullSafe(F.col("id")), F.col("leader"))
    marked = marked.select("id", "url", "payload", revisit.alias("leader"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = count = 0

        def close() -> pa.RecordBatch:
            path = files.write(folder, f"{uuid.uuid4().hex}.warc.gz", b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in batches:
            for key, url, body, leader in zip(*(batch.column(k) for k in range(4)), strict=True):
                key, leader = key.as_py(), leader.as_py()
                parts.append(_capture(None if key is None else str(key), url.as_py(), body.as_py(), None if leader is None else str(leader), date))
                size, count = size + len(parts[-1]), count + 3
                if size >= ARCHIVE_BYTES:
                    yield close()
                    parts, size, count = [], 0, 0
        if parts:
            yield close()

    return materialise(marked.mapInArrow(tidy(run), "path string, records long"))


_RECORD = "record_id string, kind string, concurrent_to string, target string, date string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """One row per record.

    Of a response, payload_bytes and payload_digest are taken from the payload
    itself, and a digest that its header doesn't confirm is an error; of a
    revisit, they come from the headers it repeats.  Memory of a task: one archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in _RECORD.replace("map<string,string>", "map").split(", ")]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for head, block in records(files.read(path)):
                    kind, payload, size, fields = head["warc-type"], None, None, None
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind in ("response", "revisit"):
                        http, _, body = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            if digest_of(body) != digest:
                                raise ValueError(f"{path}: payload of {head['warc-record-id']} has another digest")
                            payload, size = body if payloads else None, len(body)
                        else:
                            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    elif kind == "metadata":
                        fields = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
                    rows.append((head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, size, fields, payload))
                    if len(rows) >= BATCH_RECORDS:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(tidy(run), _RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One row per capture: capture_id, request, response, metadata (structs).

    The records are read once.  Each request or metadata record goes to the
    record it names, and once more, without its content, to its own id: there
    it tells those that name it which capture it belongs to.  Then a capture's
    records meet in one aggregation, at most one of a kind each (the least
    record id, if there are more).
    """
    main = F.col("kind").isin("response", "revisit")
    whole = F.struct(*rows.columns)
    entry = lambda at, root, what: F.struct(at.alias("at"), root.alias("root"), what.alias("whole"))
    nothing, no_root = F.lit(None).cast(rows.select(whole.alias("w")).schema["w"].dataType), F.lit(None).cast("string")
    own = F.array(entry(F.col("record_id"), no_root, whole))
    side = F.array(entry(F.col("concurrent_to"), no_root, whole), entry(F.col("record_id"), F.col("concurrent_to"), nothing))
    entries = rows.select(F.explode(F.when(main, own).otherwise(side)).alias("e")).select("e.at", "e.root", "e.whole").where("at is not null")
    led = entries.withColumn("root", F.min("root").over(Window.partitionBy("at"))).where("whole is not null")
    kind, key = F.col("whole.kind"), F.when(F.col("whole.kind").isin("response", "revisit"), F.col("at")).otherwise(F.coalesce("root", "at"))
    pick = lambda cond: F.min_by(F.when(cond, F.col("whole")), F.when(cond, F.col("whole.record_id")))
    grouped = led.withColumn("capture_id", key).groupBy("capture_id").agg(pick(kind == "request").alias("request"), pick(kind.isin("response", "revisit")).alias("response"), pick(kind == "metadata").alias("metadata"))
    return grouped.where("response is not null")


def archive_and_assemble(pages: DataFrame, *, folder: str | None = None, payloads: bool = True, **columns) -> DataFrame:
    """Writes pages as archives, reads them back and assembles the captures."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return assemble(read_archives(write_archives(pages, folder, **columns), payloads=payloads))

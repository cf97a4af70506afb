"""WARC archives: writing captures as transactions and assembling them again.

A capture is three records: the request, the response (or a revisit of an
earlier payload), and metadata; request and metadata name the response in
WARC-Concurrent-To.  Of captures with equal payloads of at least ``MIN_REVISIT``
bytes the one with the largest page id is stored as response, the others as
revisits that refer to it; smaller payloads are always stored.

Writing: digests are grouped to find the stored copy, with partial sums in each
task, so that a payload of any number of pages sends one row per task; then each
task writes its pages to one archive, every record a gzip member of its own.
Every attempt of a task writes an archive of its own; a table beside them lists
those that count.

Reading: archives are listed to tasks, records are parsed one after another,
and requests, responses and metadata are joined through their concurrent-to
identifiers into one nested row per capture.  A revisit's page is found by
joining its WARC-Refers-To with the responses' record identifiers, so archives of
others resolve as well.

Defined cases: null HTML is an empty payload, null addresses an empty target;
null page ids are written without the page-id field and come back null, and
they refer to nothing and are never referred to while another page has the
payload; of rows with equal page id and payload each is a capture, and one of
them is the response; records without partner give a capture with null parts;
an empty table gives no archive and no rows; extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MIN_REVISIT, LEVEL = 1000, 4
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "archive string, record_id string, type string, concurrent_to string, target string, refers_to string, page_id long, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
_NAMES = [f.split(" ")[0] for f in RECORD.split(", ")]


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def members(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of every record of a gzipped archive, one record in memory at a time."""
    z, raw, out = zlib.decompressobj(31), b"", []
    while True:
        if not raw:
            raw = data.read(1 << 20)
            if not raw:
                if out:
                    raise ValueError("the archive ends inside a record")
                return
        out.append(z.decompress(raw))
        raw = z.unused_data if z.eof else b""
        if z.eof:
            whole = b"".join(out)
            z, out = zlib.decompressobj(31), []
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = {}
            for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                fields[k.strip().lower()] = v.strip()
            yield fields, rest[: int(fields.get("content-length", "0"))]


def capture_id(page_id: object, at: int, part: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{at}/{part}')}>"


def plan(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, body, and the stored copy's page id and row number where the payload is long enough to be shared."""
    src = shared.numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body")), folder)
    src = src.withColumn("digest", F.unhex(F.sha2("body", 256)))
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("top"), "uid"))
    stored = src.where(F.length("body") >= min_revisit).groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1").select("digest", "best")
    return src.join(stored, "digest", "left").select("page_id", "url", "body", "uid", F.col("best.top").alias("top"), F.col("best.uid").alias("top_uid"))


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write archives below ``folder``; the table of archives (name, captures) comes back."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        # each attempt has an archive of its own, and the table of archives lists the one that counts
        name, n, out = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", 0, None
        for b in shared.small_batches(batches):
            for page, url, body, uid, top, top_uid in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if out is None:
                    fs, root = shared.open_fs(folder)
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(record("warcinfo", [("WARC-Record-ID", capture_id(name, 0, "info")), ("WARC-Date", DATE)], b"software: quillspark\r\n"))
                n += 1
                digest = hashlib.sha1(body).hexdigest()
                again = top_uid is not None and top_uid != uid
                own = capture_id(page, uid, "response")
                every = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
                if again:
                    refers = [("WARC-Refers-To", capture_id(top if top != -(1 << 63) else None, top_uid, "response")), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                else:
                    refers = []
                out.write(record("revisit" if again else "response", [("WARC-Record-ID", own), *every, ("WARC-Payload-Digest", f"sha1:{digest}"), *refers, ("Content-Type", "application/http; msgtype=response")], HTTP_HEAD + (b"" if again else body)))
                path = "/" + url.split("://", 1)[-1].partition("/")[2]
                out.write(record("request", [("WARC-Record-ID", capture_id(page, uid, "request")), *every, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1\r\n\r\n".encode("utf-8", "replace")))
                about = ([f"page-id: {page}"] if page is not None else []) + [f"payload-length: {len(body)}"]
                out.write(record("metadata", [("WARC-Record-ID", capture_id(page, uid, "metadata")), *every, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], "".join(f"{x}\r\n" for x in about).encode()))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "captures": [n]}, schema=pa.schema([("name", pa.string()), ("captures", pa.int64())]))

    return shared.stored(plan(pages, folder, min_revisit).mapInArrow(run, "name string, captures long").repartition(1), f"{folder}/archives")  # one row an archive


def records(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives, see RECORD; digests and lengths are those of the bytes read.

    A revisit's payload is null, its digest comes from its field and its length from its metadata record.
    """
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in _NAMES])

    def run(batches):
        fs, root = shared.open_fs(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for fields, block in members(f):
                        kind = fields.get("warc-type")
                        row = dict.fromkeys(_NAMES) | {"archive": name, "record_id": fields.get("warc-record-id"), "type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "target": fields.get("warc-target-uri"), "fields": list(fields.items())}
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest()} | ({"payload": body} if payloads else {})
                            if fields.get("warc-payload-digest", "").removeprefix("sha1:") not in ("", row["payload_digest"]):
                                raise ValueError(f"{name}: the payload of {row['record_id']} does not have its digest")
                        elif kind == "revisit":
                            row |= {"payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": fields.get("warc-refers-to")}
                        elif kind == "metadata":
                            about = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
                            row |= {"page_id": int(about["page-id"]) if "page-id" in about else None, "payload_bytes": int(about["payload-length"]) if "payload-length" in about else None}
                        rows.append(row)
                        held += len(block) + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = [r["name"] for r in archives.select("name").collect()]  # one row per archive
    frame = archives.sparkSession.createDataFrame([(n,) for n in sorted(names)], "name string")
    return frame.repartition(max(1, len(names)), "name").mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, response, request, metadata."""
    part = F.struct("record_id", "type", "target", "refers_to", "payload_bytes", "payload_digest", "payload", "fields")
    main = found.where("type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), part.alias("response"))
    asked = found.where("type = 'request' and concurrent_to is not null").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target", "fields").alias("request"))
    about = found.where("type = 'metadata' and concurrent_to is not null").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "page_id", "payload_bytes", "fields").alias("metadata"))
    return main.join(asked, "capture_id", "full").join(about, "capture_id", "full").select("capture_id", "metadata.page_id", "response", "request", "metadata")


def referred(rows: DataFrame, folder: str) -> DataFrame:
    """Captures with a column ``refers_to_page``: the page of the response that a revisit's WARC-Refers-To names.

    The names are made distinct within tasks before they meet, so a response that many revisits name is looked up once.
    """
    spark = rows.sparkSession
    asked = rows.where("response.refers_to is not null").select(F.col("response.refers_to").alias("capture_id")).distinct()
    found = shared.stored(asked.join(rows.where("response.type = 'response'").select("capture_id", "page_id"), "capture_id").select(F.col("capture_id").alias("__named"), F.col("page_id").alias("refers_to_page")), f"{folder}/referred")
    few = spark.read.schema(found.schema).parquet(f"{folder}/referred").limit(100_001).count() <= 100_000
    return rows.join(F.broadcast(found) if few else found, F.col("response.refers_to") == F.col("__named"), "left").drop("__named")


def report(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the pages, read the archives back, and report every capture."""
    archives = write(pages, folder, min_revisit)
    found = shared.stored(records(archives, folder, payloads=False), f"{folder}/records")
    rows = shared.stored(captures(found).select("capture_id", "page_id", F.col("response").dropFields("fields", "payload").alias("response"), F.col("metadata").dropFields("fields").alias("metadata")), f"{folder}/captures")
    rows = referred(rows, folder)
    out = rows.select("page_id", F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
    out = shared.stored(out, f"{folder}/report")
    for part in ("records", "captures", "referred", "numbered"):
        shared.remove(pages.sparkSession, f"{folder}/{part}")
    return out


ORACLE = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    g AS (SELECT body, max(page_id) AS top, count(*) AS n FROM p GROUP BY body)
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
        CASE WHEN strlen(body) >= {MIN_REVISIT} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN strlen(body) >= {MIN_REVISIT} AND page_id <> top THEN top END AS refers_to
    FROM p JOIN g USING (body)"""

"""WARC archives: write, normalise monolithic gzip files, index, read back.

``write_archives`` writes each task's records as one gzip stream over the whole file, the
form that can't be entered in the middle. ``normalise_archives`` inflates each such file once
as a stream, writes every record as a gzip member of its own and a sidecar index (offset and
length of every member). ``read_archives`` deals the index out and reads members by offset.

Of records with equal payloads of at least ``least`` bytes, that with the largest key is
``response`` and the others ``revisit`` it, without a payload of their own but with its
digest, length and the key they refer to.

Defined cases: a null payload is empty; a null key is never the largest unless all keys of
the payload are null, and then all are responses; rows with the same largest key are all
responses; a null url gives a record without target; an empty table gives no files; equal
payloads (a hot one too) meet only as counts, and the join on the digest is one that
Spark splits where it is skewed. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm import files
from watchloom.llm.common import spread, stored
from watchloom.session import new_run_dir

CHUNK = 1 << 20
FILE_BYTES = 256 << 20
LEVEL = 3
NAME_SCHEMA = "file string, n_records long"
READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
INDEX = [("offset", "<u8"), ("length", "<u8")]


def record_types(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """key, url, payload (binary), record_type and refers_to of every page."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    each = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload")).withColumn("_digest", F.sha1("payload"))
    groups = each.groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = each.join(groups, "_digest", "left")
    revisit = F.coalesce((F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("_last")), F.lit(False)) & F.col("_n").isNotNull()
    return marked.select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_last")).alias("refers_to")
    )


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{key}')}>"


def encode_record(key: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if key is not None:
        head.append(f"X-Page-Id: {key}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def write_archives(records: DataFrame, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Monolithic files of about ``file_bytes`` before compression at most; returns (file, n_records)."""
    folder = new_run_dir(records.sparkSession, "warc-whole")
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encoded():
            for b in batches:
                for i in range(b.num_rows):
                    yield encode_record(*(b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "record_type", "refers_to")))

        source = encoded()
        record = next(source, None)
        while record is not None:
            name, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with files.writing(name) as out:
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                while record is not None and (not count or size + len(record) <= file_bytes):
                    out.write(deflate.compress(record))
                    count, size = count + 1, size + len(record)
                    record = next(source, None)
                out.write(deflate.flush())
            yield files.rows(schema, file=[name], n_records=[count])

    return stored(records.mapInArrow(write, NAME_SCHEMA), "warc-names")


def inflated(src) -> Iterator[bytes]:
    """Decompressed chunks of a gzip file of one member or several, each of bounded size."""
    inflate = zlib.decompressobj(31)
    while data := src.read(CHUNK):
        while data:
            got = inflate.decompress(data, CHUNK)
            if got:
                yield got
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
            else:
                data = inflate.unconsumed_tail
    if tail := inflate.flush():
        yield tail


def cut_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of chunks; memory holds one record and one chunk."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while True:
        at, seen = -1, 0
        while at < 0:
            at = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held)
            if at < 0 and not fill(seen + 1):
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
        end = at + 4 + int(fields(bytes(held[:at]))["content-length"]) + 4
        if not fill(end):
            raise ValueError("the archive ends inside a record")
        yield bytes(held[:end])
        del held[:end]


def normalise_archives(names: DataFrame, level: int = LEVEL) -> DataFrame:
    """Rewrite each file with a member for every record and its sidecar index; returns (file, n_records)."""
    folder = new_run_dir(names.sparkSession, "warc-members")
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["file"].to_pylist():
                to, at, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with files.reading(name) as src, files.writing(to) as out, files.writing(f"{to}.index") as index:
                    for record in cut_records(inflated(src)):
                        member = zlib.compressobj(level, zlib.DEFLATED, 31)
                        data = member.compress(record) + member.flush()
                        out.write(data)
                        index.write(np.array([(at, len(data))], INDEX).tobytes())
                        at, count = at + len(data), count + 1
                yield files.rows(schema, file=[to], n_records=[count])

    return stored(spread(names, "file").mapInArrow(rewrite, NAME_SCHEMA), "warc-members")


def read_archives(names: DataFrame, per_task: int = 2000, payloads: bool = True) -> DataFrame:
    """Every record, read by its offset; runs of ``per_task`` index entries are dealt out. ``payloads=False`` leaves the bodies out."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                with files.mapped(f"{run['file']}.index", INDEX) as index, files.reading(run["file"]) as src:
                    got: list[tuple] = []
                    size = 0
                    for offset, length in index[run["first"] : run["first"] + per_task].tolist():
                        src.seek(offset)
                        row = parse_record(zlib.decompress(src.read(length), 31), payloads)
                        got.append((*row, run["file"], offset, length))
                        size += len(row[2] or b"")
                        if size > 8 * CHUNK:
                            yield files.rows(schema, **dict(zip(schema.names, zip(*got, strict=True), strict=True)))
                            got, size = [], 0
                    if got:
                        yield files.rows(schema, **dict(zip(schema.names, zip(*got, strict=True), strict=True)))

    runs = names.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1, F.lit(per_task).cast("long"))).alias("first"))
    return spread(runs, "file", "first").mapInArrow(read, READ_SCHEMA)


def parse_record(record: bytes, payloads: bool) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    meta = fields(head)
    http, _, body = rest[: int(meta["content-length"])].partition(b"\r\n\r\n")
    kind = meta["warc-type"]
    number = lambda k: int(meta[k]) if k in meta else None
    if kind == "response":
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        if meta["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"the payload of record {meta['warc-record-id']} does not fit its digest")
    else:
        size, digest = int(fields(http)["content-length"]), meta["warc-payload-digest"].removeprefix("sha1:")
    return number("x-page-id"), meta.get("warc-target-uri"), body if payloads and kind == "response" else None, size, digest, kind, number("x-refers-to-page-id")


def warc_table(pages: DataFrame, least: int = 0) -> DataFrame:
    members = normalise_archives(write_archives(record_types(pages, least=least)))
    return read_archives(members, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives with revisit records: deduplicated writing, and reading back.

Headers alone (id, address, payload digest, length) are shuffled to find, of the records with equal payloads, the one
with the smallest id; that verdict is joined to the pages by digest. The archives then hold one response for it and a
revisit record, without payload, for each other page. A response's block is an HTTP message whose body is the
payload. Each record is a gzip member of its own, so a reader can start at any record; each archive opens with a
warcinfo record, and all record headers are written anew.

Archives are written under another name and renamed; only archives that finished tasks report are read.

Defined cases: a null or empty payload is a response of 0 bytes; payloads under MIN_REVISIT_BYTES are always
responses; rows that repeat the smallest id of a payload are all responses; a null id is written without one, counts
as larger than any other, and is a response if no equal payload has an id; an empty table gives no archive. A null
address is written without one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, open_bytes, settle, small_batches, write_bytes

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=4)}>"


def record(fields: list[tuple[str, object]], block: bytes = b"") -> bytes:
    """One record; a field that is None is left out, line ends in values are escaped."""
    lines = [VERSION]
    for name, value in [*fields, ("Content-Length", len(block))]:
        if value is not None:
            lines.append(f"{name}: {value}".replace("\r", "%0D").replace("\n", "%0A").encode())
    return b"\r\n".join([*lines, b"", block, b"", b""])


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    common = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Page-Id", page_id),
        ("Payload-Length", size),
    ]
    if revisit:
        return record([*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("Refers-To-Page-Id", first)])
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    return record([*common, ("Content-Type", "application/http; msgtype=response")], message + payload)


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, member by member; memory is bounded by one record."""
    with open_bytes(path) as f:
        rest = b""
        while True:
            unpack, data = zlib.decompressobj(31), []
            while not unpack.eof:
                rest = rest or f.read(1 << 20)
                if not rest:
                    if data:
                        raise ValueError(f"{path} ends within a record")
                    return
                data.append(unpack.decompress(rest))
                rest = unpack.unused_data
            head, _, body = b"".join(data).partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            if version.encode() != VERSION:
                raise ValueError(f"{path} holds no WARC record where one is due")
            fields = dict(line.split(": ", 1) for line in lines)
            yield fields, body[: int(fields["Content-Length"])]


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, first, revisit) of every page."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    size, digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    shared = (
        rows.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"))
        .filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & F.col("first").isNotNull())
        .drop("copies")
    )
    joined = rows.withColumns({"payload_bytes": size, "payload_digest": digest}).join(shared, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "first", revisit.alias("revisit")
    )


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None, date: str = DATE) -> DataFrame:
    """Writes the archives below ``path`` and returns the manifest: (archive, records)."""
    spark = pages.sparkSession
    small_batches(spark)
    path = path or fresh_path(spark, "warc")

    def run(batches):
        members, size, count = [], 0, 0
        info = gzip_member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

        def close():
            archive = f"{path}/{uuid.uuid4().hex}.warc.gz"
            write_bytes(archive, [info, *members])
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([count], pa.int64())], names=["archive", "records"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for page_id, url, payload, length, digest, first, revisit in zip(*columns, strict=True):
                member = gzip_member(page_record(page_id, url, payload or b"", length, digest, first, revisit, date))
                members.append(member)
                size += len(member)
                count += 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    members, size, count = [], 0, 0
        if members:
            yield close()

    return settle(resolve(pages, id_col, url_col, payload_col).mapInArrow(run, "archive string, records long"), "warc-manifest")


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per page record of the archives. A response's length and digest are taken from its payload anew."""
    parts = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def rows(path: str):
        number = lambda x: None if x is None else int(x)
        for fields, block in records(path):
            kind = fields["WARC-Type"]
            if kind not in ("response", "revisit"):
                continue
            size, digest = int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: a payload is not what its header says")
                size = len(payload)
            refers = number(fields.get("Refers-To-Page-Id")) if kind == "revisit" else None
            yield number(fields.get("Page-Id")), fields.get("WARC-Target-URI"), size, digest, kind, refers

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(some):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                some = []
                for row in rows(path):
                    some.append(row)
                    if len(some) == 2000:
                        yield batch_of(some)
                        some = []
                if some:
                    yield batch_of(some)

    return manifest.select("archive").repartition(parts, "archive").mapInArrow(run, SCHEMA)

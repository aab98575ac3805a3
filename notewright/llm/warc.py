"""Content-addressed WARC archive.

An archive is two tables in a folder: ``payloads`` holds each distinct payload's bytes once, under its SHA-256;
``headers`` holds each record's exact header bytes.  A join on the digest gives the original records back;
stored bytes are hashed again when they are read, and a record whose payload doesn't match its digest or length is an error.

Among records with equal payloads of at least ``min_bytes`` bytes, those of the smallest page_id are
``response``, the others ``revisit``, as are rows without a page_id beside a row with one; smaller
payloads are all ``response``.  A null payload is empty.  Rows: one for each input row, repeated ones included.
An empty table makes an archive with no record.  Other columns than the id, url and payload aren't read, whatever their names.
A digest that very many records have is joined apart, so that no task gets all of them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    sha1, sha256, n = [], [], []
    for x in batch.column(3):
        data = x.as_py()
        sha1.append(base32(data))
        sha256.append(hashlib.sha256(data).hexdigest())
        n.append(len(data))
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sha1, pa.string()), pa.array(sha256, pa.string())], ["uid", "page_id", "url", "n", "sha1", "sha256"])


def record_id(uid: int, page_id, sha256: str) -> str:
    """A record's URI; uid is the row's number in the archive, so that equal rows are records of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uid}|{page_id}|{sha256}')}>"


def header(uid, page_id, url, n: int, sha1: str, sha256: str, first, first_uid, revisit: bool) -> bytes:
    """A revisit's block is empty: its block digest is that of no bytes, its payload digest that of the payload it refers to."""
    clean = lambda x: " ".join(str(x).split())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(uid, page_id, sha256)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {clean(url)}"] * (url is not None) + [f"X-Page-ID: {page_id}"] * (page_id is not None)
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{base32(b'') if revisit else sha1}", f"X-Payload-SHA256: {sha256}", f"X-Payload-Length: {n}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first_uid, first, sha256)}", f"X-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else n}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(data: bytes) -> dict[str, str]:
    head, end, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not end or rest or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC 1.1 record header")
    return dict(x.split(": ", 1) for x in lines[1:])


def _headers(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [header(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["header"])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the archive of all rows to the folder ``path``."""
    common.prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), (F.col(url_col) if url_col in pages.columns else F.lit(None)).cast("string").alias("url"), common.text_bytes(payload_col).alias("payload"))
    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", "payload")
    meta = common.materialise(common.arrow_map(numbered, _digests, "uid long, page_id long, url string, n long, sha1 string, sha256 string"), "warc-digests")
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uid"))).alias("least")
    owner = meta.where(F.col("n") >= min_bytes).groupBy("sha256").agg(least).where("least is not null").select("sha256", F.col("least.page_id").alias("first"), F.col("least.uid").alias("first_uid"))
    typed = common.join_hot(meta, owner, "sha256").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    heads = typed.select("uid", "page_id", "url", "n", "sha1", "sha256", "first", "first_uid", "revisit")
    common.arrow_map(heads, _headers, "header binary").write.parquet(f"{path}/headers")
    # equal payloads are put together before the shuffle, so a frequent one costs a row a task
    store = rows.select(F.sha2("payload", 256).alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
    store.write.parquet(f"{path}/payloads")


def _parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    for x in batch.column(0):
        h = parse_header(x.as_py())
        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
        for col, v in zip(cols, (number("X-Page-ID"), h["WARC-Type"], number("X-Refers-To-Page-ID"), h["X-Payload-SHA256"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), x.as_py()), strict=True):
            col.append(v)
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "record_type", "refers_to", "sha256", "sha1", "n", "header"])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    common.prepare(spark)
    stored = spark.read.schema("header binary").parquet(f"{path}/headers")
    return common.arrow_map(stored, _parsed, "page_id long, record_type string, refers_to long, sha256 string, sha1 string, n long, header binary")


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, n, sha1 = [], [], []
    for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        data = x.as_py()
        if hashlib.sha256(data).hexdigest() != key:
            raise ValueError(f"stored payload {key} is damaged")
        keys.append(key)
        n.append(len(data))
        sha1.append(base32(data))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array(sha1, pa.string())], ["sha256", "stored_n", "stored_sha1"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from what is stored, each payload verified."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    checked = common.arrow_map(stored, _verified, "sha256 string, stored_n long, stored_sha1 string")
    heads = common.materialise(read_headers(spark, path).drop("header"), "warc-records")
    found = common.join_hot(heads, common.materialise(checked, "warc-checked"), "sha256")
    same = (F.col("n") == F.col("stored_n")) & (F.col("sha1") == F.col("stored_sha1"))
    bad = F.raise_error(F.concat(F.lit("no matching payload for "), F.col("sha256")))
    return found.select("page_id", F.when(same, F.col("stored_n")).otherwise(bad.cast("long")).alias("payload_bytes"), F.col("stored_sha1").alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): each record's bytes as WARC has them; a revisit's block is empty."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    heads = read_headers(spark, path).select("page_id", "record_type", "sha256", "header")
    end = F.lit(b"\r\n\r\n")
    full = common.join_hot(common.materialise(heads.where("record_type = 'response'"), "warc-records"), stored, "sha256").select("page_id", F.concat("header", "payload", end).alias("record"))
    return full.unionAll(heads.where("record_type <> 'response'").select("page_id", F.concat("header", end).alias("record")))

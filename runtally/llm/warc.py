"""A content-addressed web archive: payload bytes once by a verified strong digest, record headers apart, records by joins.

``payloads`` holds every distinct payload under its SHA-256; ``headers`` holds the exact header bytes of every WARC/1.1 record and
the digest of its payload. Among equal payloads the record with the largest page_id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from runtally.llm.rows import kept, mapped, steps, texts

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

_FIRST = -(1 << 63)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record_id: str) -> int | None:
    last = record_id.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def header(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """The exact bytes before the payload: WARC header, empty line, HTTP header, empty line.

    A revisit's block ends with its HTTP header; a response's goes on with the payload. Line ends within a url are percent-encoded.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to))]
    block = len(http) + (0 if revisit else size)
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(block))]
    return ("\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]) + END + http).encode()


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of the bytes of a record."""
    head, _, block = record.partition(END.encode())
    http, _, payload = block.partition(END.encode())

    def fields(raw: bytes, first: bytes) -> dict[str, str]:
        top, *rest = raw.decode().split("\r\n")
        if not top.startswith(first.decode()):
            raise ValueError(f"a record must begin with {first.decode()}: {top[:40]}")
        return dict(x.split(": ", 1) for x in rest)

    return fields(head, VERSION.encode()), fields(http, b"HTTP/"), payload


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, bytes, sha1, sha256 of every page; a null html is empty."""
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        payloads = [t.encode() for t in texts(part, "html")]
        return pa.RecordBatch.from_arrays([
            part.column("page_id"), part.column("url"), pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([payload_digest(p) for p in payloads], pa.string()), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary())],
            ["page_id", "url", "bytes", "sha1", "sha256"])

    return mapped(pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html"), run,
                  "page_id long, url string, bytes long, sha1 string, sha256 binary")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``payloads`` and ``headers`` under ``path``.

    Payloads below ``least_bytes`` are stored once as well, but their records are all responses. A null page_id counts as the
    smallest; rows that repeat page_id and payload get the same type. Digests decide alone who keeps a payload: the large bytes
    are shuffled once, by the keeper's page_id, so that a payload many pages share does not gather in one task.
    """
    found = kept(digests(pages).withColumn("o", F.coalesce("page_id", F.lit(_FIRST))))
    keepers = kept(found.groupBy("sha256").agg(F.max("o").alias("keeper")))
    html = pages.select(F.coalesce(pages["page_id"].cast("long"), F.lit(_FIRST)).alias("keeper"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    stored = html.withColumn("sha256", F.unhex(F.sha2("payload", 256))).join(keepers, ["keeper", "sha256"]).dropDuplicates(["keeper", "sha256"])
    stored.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")

    def head(part: pa.RecordBatch) -> pa.RecordBatch:
        out = [header(p, u, n, d, None if k == _FIRST else k, r) for p, u, n, d, k, r in zip(
            *(part.column(c).to_pylist() for c in ("page_id", "url", "bytes", "sha1", "keeper", "revisit")))]
        return pa.RecordBatch.from_arrays([part.column("sha256"), pa.array(out, pa.binary())], ["sha256", "header"])

    revisit = (F.col("bytes") >= least_bytes) & (F.col("o") != F.col("keeper"))
    mapped(found.join(keepers, "sha256").select("page_id", "url", "bytes", "sha1", "keeper", revisit.alias("revisit"), "sha256"), head,
           "sha256 binary, header binary").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, payload of every record: the full payload also for revisits. A payload that is missing or fails its digest ends the job."""
    joined = spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads"), "sha256", "left")
    good = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    return joined.select("header", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a payload is missing or damaged"))).alias("payload"))


def records(archive: DataFrame) -> DataFrame:
    """The bytes of every record as it stands in a WARC file: a response with its payload, a revisit without."""
    revisit = F.contains(F.substring("header", 1, 64), F.lit(b"WARC-Type: revisit"))
    return archive.select(F.when(revisit, F.col("header")).otherwise(F.concat("header", "payload")).alias("record"))


def write_warc(archive: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Compressed WARC files of bounded numbers of records; the line separator of the writer is the end of a record."""
    records(archive).select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(path)


def split_records(raw: bytes) -> Iterator[bytes]:
    """The records of a WARC file, by their Content-Length."""
    if raw[:2] == b"\x1f\x8b":
        members, rest = [], raw
        while rest:
            one = zlib.decompressobj(31)
            members.append(one.decompress(rest) + one.flush())
            rest = one.unused_data
        raw = b"".join(members)
    at = 0
    while at < len(raw):
        body = raw.index(END.encode(), at) + len(END)
        size = next(int(x.split(b":", 1)[1]) for x in raw[at:body].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield raw[at:body + size]
        at = body + size + len(END)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record`` of every record in the files under a path; a file is read by one task."""
    def run(batches):
        for part in batches:
            for raw in part.column("content").to_pylist():
                found = list(split_records(raw))
                for at in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at:at + 256], pa.binary())], ["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record binary")


def described(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of an archive read back, each payload checked again."""
    def run(batches):
        for part in steps(batches):
            out = []
            for head, payload in zip(part.column("header").to_pylist(), part.column("payload").to_pylist()):
                warc, http, _ = parse(head)
                digest = payload_digest(payload)
                if warc["WARC-Payload-Digest"] != f"sha1:{digest}" or int(http["Content-Length"]) != len(payload):
                    raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
                to = warc.get("WARC-Refers-To")
                out.append((page_of(warc["WARC-Record-ID"]), len(payload), digest, warc["WARC-Type"], None if to is None else page_of(to)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archive.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

"""WARC archives with revisit records, resolved by a shuffle of headers.

Headers (id, payload digest, payload length) are made without the payloads, grouped by digest, and
joined back: of equal payloads of at least ``revisit_from`` bytes the largest id is the original
response, the others become revisits that refer to it. Records are then written with fresh headers.

Archives are text files whose line separator is the blank line that ends a WARC record, so Spark's
own writer commits them (retried tasks leave nothing behind) to any file system; readers go by
Content-Length. Payloads pass as UTF-8 unchanged.

Defined results: a null payload is empty, and so a response; rows with a null id keep it and are
responses, but no original; repeated ids are records of their own; a null URL is written as ``urn:none`` and
line breaks in URLs are percent-encoded; an empty table gives an archive without records; other
input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.tables import shared_folder

REVISIT_FROM = 1000
#: Records in one archive file, so that a reader's task stays small.
FILE_RECORDS = 4000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def resolve_revisits(headers: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Add record_type and refers_to to headers (page_id, payload_digest, payload_bytes).

    The group of a digest is reduced to its largest id before the shuffle, and the join back splits
    hot digests by the engine's skew handling.
    """
    large = F.col("payload_bytes") >= revisit_from
    originals = headers.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = headers.join(originals, "payload_digest", "left")
    revisit = large & F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("refers_to")))


def header_block(payload: F.Column) -> tuple[F.Column, F.Column]:
    """Digest and length of a payload column."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    return F.sha1(body), F.length(body).cast("long")


def write_archives(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = REVISIT_FROM, date: str = DATE, compression: str = "gzip") -> None:
    """Write one WARC record for each row, revisits without their payload."""
    digest, length = header_block(F.col(payload))
    # only headers are shuffled by digest; the few that are revisits are joined to the rows by id
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"), digest.alias("payload_digest"), length.alias("payload_bytes"))
    large = rows.where(F.col("payload_bytes") >= revisit_from).select("page_id", "payload_digest", "payload_bytes")
    kinds = resolve_revisits(large, revisit_from).where("record_type = 'revisit'").select("page_id", "payload_digest", "refers_to").distinct()
    rows = rows.join(kinds, ["page_id", "payload_digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    target = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("urn:none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    name = lambda x: F.concat(F.lit("<urn:loomgraph:page:"), x.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        F.coalesce(name(F.col("page_id")), F.lit("<urn:loomgraph:page:none>")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        end = head + 4 + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length")
        yield fields, data[head + 4 : end]
        at = end + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives in a folder; payload is null unless ``payloads``, and for revisits."""

    def page_of(name: str | None) -> int | None:
        last = (name or "").rstrip(">").rpartition(":")[2]
        return int(last) if last.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                data = zlib.decompress(data, 31) if name.endswith(".gz") else data
                rows = []
                for fields, block in records(data):
                    head, _, body = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), body if payloads and fields["WARC-Type"] == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=[f.split()[0] for f in READ_SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, READ_SCHEMA)


def warc_round_trip(pages: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path, page, url, payload, revisit_from)
    return read_archives(spark, path)

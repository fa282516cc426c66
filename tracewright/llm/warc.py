"""WARC archives: writing captures with revisit records, reading records, assembling transactions.

A capture is written as a request, a response (or, where an equal payload is stored already, a revisit) and a
metadata record; the request and the metadata name the response in WARC-Concurrent-To. Records are written by
Spark's own text sink, gzip-compressed, so archives go wherever the session can write, and read back through
its binaryFile source, a file at a time. Captures are dealt to archives by the size of their payloads, so that each
archive has at most ``archive_bytes`` of them before compression, or one capture. Transaction assembly joins the
three kinds of record through the concurrent-to identifiers into one nested row per capture.

Defined results: a null payload is empty; a null url gives no WARC-Target-URI; line breaks in a url are
percent-encoded; a row with a null page id is always a response; identical rows share their record ids and are as
many captures; a request or metadata record whose response is missing gives no capture; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.session import Scratch

EOL = "\r\n"
SMALL = 1 << 16
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Five hex digits are four of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    digits = [F.lpad(F.conv(F.substring(hexed, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*digits), *BASE32)


def record_id(kind: str, *of: Column) -> Column:
    x = F.md5(F.concat_ws("\x00", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("")) for c in of)))
    return F.concat(F.lit("<urn:uuid:"), *(y for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for y in (F.substring(x, a, n), F.lit("-"))), F.substring(x, 21, 12), F.lit(">"))


def _record(fields: dict[str, Column | str], block: Column) -> Column:
    lines = [F.lit("WARC/1.0")]
    for name, value in fields.items():
        lines.append(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value))  # null: no line
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL * 2), block)


def write_warc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", smallest: int = 0, archive_bytes: int = 128 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of all rows under ``path``; payloads of at least ``smallest`` bytes are stored once."""
    clean = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id).alias("id"), clean.alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body"), "same": F.sha2("body", 256), "digest": base32_sha1(F.col("body"))})
    firsts = rows.where("id is not null").groupBy("same").agg(F.min(F.struct("id", "url")).alias("first"))
    rows = rows.join(firsts, "same", "left")
    again = F.coalesce((F.col("id") > F.col("first.id")) & (F.col("size") >= smallest), F.lit(False))
    own = record_id("response", F.col("id"), F.col("url"), F.col("digest"))
    stored = record_id("response", F.col("first.id"), F.col("first.url"), F.col("digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL * 2))
    place = F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 1)
    target = F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{EOL}Host: "), place, F.lit(EOL * 2))
    facts = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"{EOL}payload-bytes: "), F.col("size").cast("string"), F.lit(EOL))
    common = {"WARC-Date": date, "WARC-Target-URI": F.col("url")}
    texts = [
        _record({"WARC-Type": "request", "WARC-Record-ID": record_id("request", F.col("id"), F.col("url"), F.col("digest")), "WARC-Concurrent-To": own, **common, "Content-Type": "application/http; msgtype=request"}, asked),
        _record(
            {
                "WARC-Type": F.when(again, "revisit").otherwise("response"),
                "WARC-Record-ID": own,
                **common,
                "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
                "WARC-Refers-To": F.when(again, stored),
                "WARC-Profile": F.when(again, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                "Content-Type": "application/http; msgtype=response",
            },
            F.when(again, head).otherwise(F.concat(head, F.col("body"))),
        ),
        _record({"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", F.col("id"), F.col("url"), F.col("digest")), "WARC-Concurrent-To": own, **common, "Content-Type": "application/warc-fields"}, facts),
    ]
    # the sink ends each row, and so each capture's last record, with the blank lines that end a record
    lines = rows.select("size", F.concat_ws(EOL * 2, *texts).alias("value"))
    most, low = rows.agg(F.max("size")).first()[0], -1
    for high in (SMALL << shift for shift in range(0, 33, 4)):  # payloads up to 64 KiB, 1 MiB, 16 MiB, ...
        if low < 0 or most is not None and low < most:
            own = lines.where((F.col("size") > low) & (F.col("size") <= high)).select("value")
            own.write.option("compression", "gzip").option("lineSep", EOL * 2).option("maxRecordsPerFile", max(1, archive_bytes // high)).text(f"{path}/up-to-{high}")
        low = high


RECORD = pa.schema(
    [(n, pa.string()) for n in ("record_id", "type", "date", "uri", "concurrent_to", "refers_to", "digest_header")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
RECORD_DDL = "record_id string, type string, date string, uri string, concurrent_to string, refers_to string, digest_header string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def _header(stream) -> dict[bytes, str] | None:
    """The fields of the next record, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not the start of a record: {line[:60]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode()
    return fields


def parse(content: bytes, with_payload: bool):
    """The records of an archive, compressed or not, read as a stream."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while (head := _header(stream)) is not None:
        block = stream.read(int(head.get(b"content-length", "0")))
        kind, payload, fields = head.get(b"warc-type"), block, []
        if head.get(b"content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif head.get(b"content-type") == "application/warc-fields":
            fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode().splitlines() if ":" in line]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
        names = (b"warc-record-id", b"warc-type", b"warc-date", b"warc-target-uri", b"warc-concurrent-to", b"warc-refers-to", b"warc-payload-digest")
        yield (*(head.get(n) for n in names), len(payload), digest, fields, payload if with_payload else None)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives under ``path``."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in parse(content.as_py(), with_payload):
                    held.append(record)
                    size += len(record[-1] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), RECORD)], schema=RECORD)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), RECORD)], schema=RECORD)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(read, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, uri, date, request, response, metadata, stored).

    ``stored`` is the response that a revisit refers to, with the fields of its metadata record.
    """
    # identical rows wrote identical records: each is taken once, and its captures are given as often as it was found
    held = records.groupBy("record_id").agg(F.first(F.struct(*(c for c in records.columns if c != "record_id"))).alias("r"), F.count("*").alias("copies"))
    kept = held.select("record_id", "copies", "r.*")
    answers = kept.where("type in ('response', 'revisit')")
    part = lambda kind, *names: kept.where(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", *names).alias(kind))
    whole = answers.join(part("request", "payload"), "record_id", "left").join(part("metadata", "fields"), "record_id", "left")
    source = kept.where("type = 'response'").select("record_id", "payload_bytes", "payload_digest")
    source = source.join(part("metadata", "fields"), "record_id", "left").select(F.col("record_id").alias("source"), F.struct("record_id", "payload_bytes", "payload_digest", F.col("metadata.fields").alias("fields")).alias("stored"))
    # responses refer to nothing: keys of their own keep them from meeting in one task
    whole = whole.withColumn("source", F.coalesce("refers_to", F.concat(F.lit("none of "), "record_id"))).join(source, "source", "left")
    answer = F.struct("type", "digest_header", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response")
    found = whole.select(F.col("record_id").alias("capture_id"), "uri", "date", "request", answer, "metadata", "stored", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return found.drop("copy")


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", smallest: int = 0) -> DataFrame:
    """Write all pages, read the archives back: (id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_warc(pages, path, id, url, payload, smallest)
    captures = assemble(scratch.save(read_warc(spark, path, with_payload=False), "records"))
    kind = pages.schema[id].dataType.simpleString()
    number = lambda fields: F.nullif(fields["page-id"], F.lit("")).cast(kind)
    revisit = F.col("response.type") == "revisit"
    return captures.select(
        number(F.col("metadata.fields")).alias(id),
        F.when(revisit, F.col("stored.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stored.payload_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(revisit, number(F.col("stored.fields"))).alias("refers_to"),
    )

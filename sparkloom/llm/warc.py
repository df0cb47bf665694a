"""WARC archives with revisit resolution (operator 10).

Headers (page_id, payload digest, size) are shuffled by digest, never payloads.
Of equal payloads of at least ``min_bytes`` bytes the record with the smallest
page_id is written as response, every other as revisit without payload, both with
fresh headers. Archives are gzip text files that Spark's writer commits to the
shared folder, so a lost executor's part is written again and nothing is left of
its first try. Reading parses whole archives by Content-Length, one after another,
and joins revisits to their responses by digest.

Only digests that occur more than once meet the payload rows again; Spark
broadcasts that table if its written size allows and splits a hot digest if not.

Null html is the empty payload. A null page_id is never the smallest while another
is not null, and makes all records responses if there is no other. Rows repeating
the smallest page_id and its payload are all responses. Empty tables give no rows.

``read_archives`` takes archives of any writer, gzip files of one member or many.
Responses, resources and revisits are rows; other records (warcinfo, request,
metadata, conversion, continuation) are passed over. A response that is no HTTP
message is all payload. A digest that is missing or no SHA-1 is computed from the
payload. Damage is told in ``status`` and never ends a job: ``digest`` for a payload that
has another digest than its header says (it is told by its own), ``truncated`` for a block
shorter than its length, ``length`` for a record without a readable length (reading goes on
at the next one) and ``gzip`` for a member that cannot be inflated (reading goes on at the
next one). Revisits are resolved by WARC-Refers-To, else by digest.

``deduplicate`` writes such archives anew, with fresh headers around the HTTP heads,
dates and payloads that were read, byte for byte: only headers are joined and shuffled
before it writes, revisits point at the fresh record of their original, and one whose
original is in no archive stays as it is. Records without a readable block are left out.

A file is one row when read, so records are written in classes of size, each with as
many to a file as ``file_bytes`` hold of the mean record, and four times ``file_bytes``
of the class's largest: no file grows past that, but for a single record that does.
Files written here have one gzip member each.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, written

END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, status string"
FULL = READ + ", date string, content_type string, http binary, payload binary"
OK, DIGEST, TRUNCATED, LENGTH, GZIP = "ok", "digest", "truncated", "length", "gzip"
CLASS = 16  # the largest record of a class is as many times that of the one below
HTTP = "application/http; msgtype=response"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 5 hex digits are 4 digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.upper(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32)), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def marked(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, float, int]:
    """page_id, url, html, bytes, digest, own_id and first_id, the record id of the response (null if it is its own); the mean of bytes and the most."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))})
    heads = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    seen = Observation()
    heads = heads.observe(seen, F.sum(F.col("bytes") * F.col("n")).alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("most"))
    shared = written(heads.where((F.col("bytes") >= min_bytes) & (F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    mean = (seen.get.get("bytes") or 0) / max(1, seen.get.get("n") or 0)
    own = F.col("first").eqNullSafe(F.col("page_id"))
    linked = rows.join(shared, "digest", "left")
    ids = {"own_id": record_id(F.col("page_id").cast("string"), F.col("digest")), "first_id": F.when(F.col("first").isNotNull() & ~own, record_id(F.col("first").cast("string"), F.col("digest")))}
    return linked.withColumns(ids).drop("first"), mean, seen.get.get("most") or 0


def record_id(name: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", name, digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def page_head(size: Column) -> Column:
    """The HTTP head of a page that was given without one."""
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def record(http: Column, kind: Column, content_type: Column, date: Column) -> Column:
    """The WARC record of a marked row, without its last line end; ``http`` is its HTTP head, empty for a resource."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", "%0A")
    revisit = F.col("first_id").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise(kind)),
        line("WARC-Record-ID", F.col("own_id")),
        line("WARC-Date", date),
        line("WARC-Target-URI", plain(F.col("url"))),
        F.coalesce(line("WARC-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.coalesce(line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("first_id")))).otherwise(""),
        line("Content-Type", plain(content_type)),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    )


def write_records(rows: DataFrame, value: Column, path: str, mean: float, largest: int, records_per_file: int = 20_000, file_bytes: int = 256_000_000) -> None:
    """Archives of marked rows; ``mean`` and ``largest`` bytes of payload to a record. A pass over the rows for each class of sizes."""
    lower, most = -1, max(1, min(records_per_file, int(file_bytes / max(mean, 1.0))))
    upper = 4 * file_bytes // most
    while lower < largest or lower < 0:
        own = rows.where((F.col("bytes") > lower) & (F.col("bytes") <= upper)) if upper < largest or lower >= 0 else rows
        out = own.select(value.alias("value")).write.mode("append").option("lineSep", "\r\n").option("compression", "gzip")
        out.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)
        lower, upper = upper, upper * CLASS
        most = max(1, 4 * file_bytes // upper)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 20_000, file_bytes: int = 256_000_000) -> None:
    """Deduplicated archives of page rows (page_id, url, html) below ``path``."""
    rows, mean, largest = marked(pages, min_bytes)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = record(page_head(F.col("bytes")), F.lit("response"), F.lit(HTTP), now)
    write_records(rows, value, path, mean, largest, records_per_file, file_bytes)


class Inflated:
    """Bytes of a gzip file of any number of members, read in parts; members that cannot be inflated are passed over and counted."""

    def __init__(self, data: memoryview, part: int = 1 << 20):
        self.data, self.part, self.at, self.buffer, self.gzip, self.damaged = data, part, 0, bytearray(), zlib.decompressobj(31), 0
        self.start, self.broken = 0, False  # of the present member; whether it broke off behind what was read last

    def _next_member(self) -> None:
        """To the next place where a member may start, or to the end."""
        self.gzip = zlib.decompressobj(31)
        while self.start + 1 < len(self.data):
            part = bytes(self.data[self.start + 1 : self.start + 1 + self.part])
            if (k := part.find(b"\x1f\x8b\x08")) >= 0:
                self.at = self.start = self.start + 1 + k
                return
            self.start += max(1, len(part) - 2)
        self.at = len(self.data)

    def _rescue(self, part: memoryview, gzip) -> None:
        """What can be inflated of a part before its damage."""
        for k in range(0, len(part), 256):
            try:
                self.buffer += gzip.decompress(part[k : k + 256])
            except zlib.error:
                return

    def more(self) -> bool:
        """Whether there were more bytes: not at the end, nor, once, where a member breaks off."""
        if self.broken:
            self.broken = False
            return False
        while True:
            if self.gzip.eof:
                self.at = self.start = self.at - len(self.gzip.unused_data)
                self.gzip = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return False
            part, before = self.data[self.at : self.at + self.part], self.gzip.copy()
            try:
                got = self.gzip.decompress(part)
            except zlib.error:
                had = len(self.buffer)
                self._rescue(part, before)
                self.damaged += any(self.data[self.start : self.start + 512])  # zeros are padding
                self._next_member()
                self.broken = len(self.buffer) > had
                return self.broken
            self.at += len(part)
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the next mark; None at the end."""
        start = 0
        while (k := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return None
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def to_record(self) -> bool:
        """To the start of the next record, if it is not there yet."""
        skipped = self.until(b"WARC/")
        if skipped is not None:
            self.buffer[:0] = b"WARC/"
        return skipped is not None


def records(data: memoryview) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """Headers, content block and status of every record of an archive."""
    stream, damaged = Inflated(data), 0
    while True:
        while damaged < stream.damaged:
            damaged += 1
            yield {}, b"", GZIP
        if not stream.to_record() or (head := stream.until(END + END)) is None:
            stream.buffer.clear()
            if stream.at >= len(stream.data) and damaged == stream.damaged:
                return
            continue
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "0")
        if not length.isascii() or not length.isdigit():
            yield headers, b"", LENGTH
            continue
        block = stream.take(int(length))
        yield headers, block, OK if len(block) == int(length) else TRUNCATED


def read_record(headers: dict[str, str], block: bytes, status: str = OK) -> tuple | None:
    """The values of FULL; None for records that are passed over."""
    kind = headers.get("warc-type", "").lower()
    if status in (LENGTH, GZIP):
        return None, headers.get("warc-target-uri"), None, None, kind or "unknown", headers.get("warc-record-id"), None, status, headers.get("warc-date"), None, b"", b""
    if kind not in ("response", "resource", "revisit"):
        return None
    http, payload = b"", block
    if block.startswith(b"HTTP/"):
        head, mark, payload = block.partition(END + END)
        http = head + mark
    told = headers.get("warc-payload-digest") or (headers.get("warc-block-digest") if kind == "resource" else None)
    told = told[5:].upper() if told and told.lower().startswith("sha1:") else None
    if kind == "revisit":
        sizes = [x.split(b":", 1)[1].strip() for x in http.split(END) if x.lower().startswith(b"content-length:")]
        n, digest, payload = (int(sizes[0]) if sizes and sizes[0].isdigit() else None), told, b""
    else:
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if told and len(told) == 32 and told != digest and status == OK:
            status = DIGEST
    page = headers.get("warc-page-id", "")
    page = int(page) if page.isascii() and page.lstrip("-").isdigit() and abs(int(page)) < 2**63 else None
    return page, headers.get("warc-target-uri"), n, digest, kind, headers.get("warc-record-id"), headers.get("warc-refers-to"), status, headers.get("warc-date"), headers.get("content-type"), http, payload


def _parsed(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for content in b.column("content"):
                for headers, block, status in records(memoryview(content.as_buffer())):
                    if (row := read_record(headers, block, status)) is None:
                        continue
                    rows.append(row if with_payload else row[: len(KINDS)])
                    size += len(block) if with_payload else 0
                    if len(rows) >= 2000 or size > 1 << 26:
                        yield _batch(rows, with_payload)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, with_payload)

    return run


KINDS = (pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 5)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [*KINDS, pa.string(), pa.string(), pa.binary(), pa.binary()] if with_payload else KINDS
    names = [x.split()[0] for x in (FULL if with_payload else READ).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per response, resource and revisit of the archives below ``path``, and per damaged place; payloads of revisits are empty.

    With payloads, also date, content_type, and http, the HTTP head with its blank line.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parsed(with_payload), FULL if with_payload else READ)


def resolved(found: DataFrame) -> DataFrame:
    """Records with refers_to: for revisits the page_id of the response they refer to, by record id, else by digest."""
    revisit = F.col("record_type") == "revisit"
    asked, own = found.where(revisit), found.where(~revisit)
    out = asked
    for key, told in (("record_id", "refers_to_id"), ("payload_digest", "payload_digest")):
        first = own.join(asked.select(F.col(told).alias(key)).distinct(), key, "left_semi").groupBy(F.col(key).alias(told)).agg(F.min("page_id").alias(f"_{key}"))
        out = out.join(first, told, "left")
    linked = out.select(*found.columns, F.coalesce("_record_id", "_payload_digest").alias("refers_to"))
    return own.withColumn("refers_to", F.lit(None).cast("long")).unionByName(linked)


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Archives of any records again, deduplicated, with fresh headers around what was read."""
    rows = written(read_archives(spark, source, with_payload=True).where(~F.col("status").isin(LENGTH, GZIP)))
    heads = rows.drop("payload", "http", "url", "date", "content_type", "status")
    full, asked = heads.where("record_type <> 'revisit'"), heads.where("record_type = 'revisit'")
    # a revisit without a digest has that of the record it refers to
    by_id = full.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("payload_digest").alias("_digest"))
    asked = asked.where("record_id IS NOT NULL").join(by_id, "refers_to_id", "left").groupBy("record_id").agg(F.min(F.coalesce("payload_digest", "_digest")).alias("told"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "record_id")).alias("first")
    first = full.groupBy(F.col("payload_digest").alias("digest")).agg(least, F.first("payload_bytes").alias("_n"))
    first = written(first.select("digest", "_n", F.col("first.record_id").alias("first_record")))
    sizes = full.agg(F.avg("payload_bytes").alias("mean"), F.max("payload_bytes").alias("most")).first()
    again = F.col("record_type") == "revisit"
    joined = rows.join(written(asked), "record_id", "left").withColumn("digest", F.when(again, F.coalesce("payload_digest", "told")).otherwise(F.col("payload_digest"))).join(first, "digest", "left")
    fresh = lambda c: record_id(F.concat(F.lit("again:"), c), F.col("digest"))
    known = F.col("first_record").isNotNull()
    same = ~F.col("first_record").eqNullSafe(F.col("record_id")) & known & (F.col("_n") >= min_bytes)
    target_id = F.when(again, F.when(known, fresh(F.col("first_record"))).otherwise(F.coalesce("refers_to_id", F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>")))).when(same, fresh(F.col("first_record")))
    out = joined.select(
        "page_id", "url", F.col("payload").cast("string").alias("html"), "digest", fresh(F.coalesce("record_id", F.lit(""))).alias("own_id"), target_id.alias("first_id"),
        F.when(again, 0).otherwise(F.col("payload_bytes")).alias("bytes"), F.col("http").cast("string").alias("http"), "date", "content_type", "record_type",
    )
    kind = F.when(F.col("record_type") == "resource", "resource").otherwise("response")
    date = F.coalesce("date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    value = record(F.col("http"), kind, F.when(F.col("http") != "", HTTP).otherwise(F.coalesce("content_type", F.lit(HTTP))), date)
    write_records(out, value, target, sizes["mean"] or 0.0, sizes["most"] or 0)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and resolve revisits."""
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write_archives(pages, path, min_bytes)
    return resolved(written(read_archives(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

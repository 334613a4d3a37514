r"""WARC archives with revisit resolution.

Headers alone (page id, url, length and digest) are shuffled by payload digest; the record with the smallest page id
of each digest is the response, the others are joined to it as revisits. The archives are then written with fresh
headers and read back by a streaming reader. A revisit has no payload, so its record is written from its header;
the responses' are written where their pages are stored, from which the revisits' places are left out
(:mod:`.places`).

Records go through Spark's own writer and reader of lines, of which the end is WARC's record end, so archives may
live wherever Spark writes, only files of committed tasks count, and a lost executor costs its tasks. A reading
task holds one record at a time, however many an archive has.

Defined results: null html is an empty payload; payloads shorter than ``min_bytes`` are all responses.
Rows repeated under the smallest id of a digest are responses each. A null id never is a response
that others refer to, unless all rows of its digest have none; then all of them are responses. Ids may be of
any type that has an order; those that aren't numbers are percent-encoded in headers. A null url has no target
header; control characters in a url are percent-encoded. Extra columns are ignored. An empty table writes no
records. Payloads of any length are one record each.

Scale: no payload is shuffled, however many digests repeat. An archive of responses holds ``max_records`` at most, and
never more than the pages of one scan task, which ``spark.sql.files.maxPartitionBytes`` bounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean_batches, lookup, scratch
from .places import in_place, marks, place, placed

DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each five bytes are eight digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, **kw) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of every page; a revisit's payload is null."""
    responses, revisits = split(pages, **kw)
    for part in responses:
        revisits = revisits.unionByName(part)
    return revisits


def split(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> tuple[list[DataFrame], DataFrame]:
    """The rows of :func:`resolve`: responses, a frame for each block of files, and revisits."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = placed(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "pages")
    of = [F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest")]
    file, row = place(rows)
    headers = cut(rows.select("page_id", "url", *of, file.alias("file"), row.alias("row")), "headers")
    again = cut(headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first"), "repeated")
    other = F.coalesce(F.col("page_id") != F.col("first"), F.lit(True))
    revisits = cut(lookup(headers, again, ["payload_digest"], "inner").where(other).withColumnRenamed("first", "refers_to"), "revisits")
    nobody = F.lit(None).cast(rows.schema["page_id"].dataType).alias("refers_to")
    responses = [part.select("page_id", "url", payload.alias("payload"), *of, nobody) for part in in_place(rows, marks(revisits.select("file", "row")), keep=False)]
    return responses, revisits.select("page_id", "url", F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest", "refers_to")


def _record(date: str) -> Column:
    """A WARC record up to its end mark."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    name = lambda page: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", F.lit("page"), page.cast("string"), F.col("payload_digest"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"\p{Cntrl}", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))), line("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        line("X-Page-Id", F.url_encode(F.col("page_id").cast("string"))), line("X-Refers-To-Page-Id", F.url_encode(F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, date: str = DATE, max_records: int = 5000, **kw) -> None:
    """Write a record for each page to gzipped archives under ``path``, of ``max_records`` at most each."""
    responses, revisits = split(pages, **kw)
    for k, part in enumerate([*responses, revisits]):
        part.select(_record(date).alias("value")).write.mode("append" if k else "error").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a byte stream that comes in chunks."""
    buffer = b""

    def fill(until) -> int:
        nonlocal buffer
        parts, size = [buffer], len(buffer)
        at = until(buffer, size)
        while at < 0:
            chunk = next(chunks, None)
            if chunk is None:
                return -1
            parts.append(chunk)
            size += len(chunk)
            if until is not None and size >= want:
                buffer = b"".join(parts)
                parts = [buffer]
                at = until(buffer, size)
        buffer = b"".join(parts)
        return at

    while True:
        want = 0
        at = fill(lambda b, n: b.find(b"\r\n\r\n"))
        if at < 0:
            if buffer.strip():
                raise ValueError("a record is cut short")
            return
        lines = buffer[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        buffer = buffer[at + 4 :]
        want = int(fields["content-length"]) + 4
        if fill(lambda b, n: 0 if n >= want else -1) < 0 or buffer[want - 4 : want] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, buffer[: want - 4]
        buffer = buffer[want:]


_READ = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.StringType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])


def read_archives(spark, path: str, payloads: bool = True, id_type: T.DataType | None = None) -> DataFrame:
    """The records under ``path``: a response's digest and length are taken from its payload, a revisit's from its headers.

    A gzipped archive is read by one task from its begin, in lines that end as records do; the reader puts lines
    together to records by their lengths. Ids are longs if no other type is given.
    """
    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary"))
    lean_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for fields, block in records(line + END.encode() for batch in batches for line in (x.as_py() for x in batch.column(0))):
            http, _, payload = block.partition(b"\r\n\r\n")
            kind = fields["warc-type"]
            if kind == "response":
                n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if fields["warc-payload-digest"] != f"sha1:{digest}":
                    raise ValueError("a payload doesn't match its digest")
            else:
                n, digest = int(http.decode().rpartition("Content-Length: ")[2]), fields["warc-payload-digest"].removeprefix("sha1:")
            rows.append((fields.get("x-page-id"), fields.get("warc-target-uri"), kind, n, digest, fields.get("x-refers-to-page-id"), payload if payloads and kind == "response" else None))
            size += len(block) if payloads else 256
            if size > 1 << 22:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    own = lambda name: F.url_decode(name).cast(id_type or T.LongType()).alias(name)
    return lines.mapInArrow(run, _READ).select(own("page_id"), "url", "record_type", "payload_bytes", "payload_digest", own("refers_to"), "payload")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_READ.names)


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **kw) -> DataFrame:
    """Write the pages' archives, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    path = path or scratch(pages.sparkSession, "warc")
    write_archives(pages, path, id_col=id_col, **kw)
    read = read_archives(pages.sparkSession, path, payloads=False, id_type=pages.schema[id_col].dataType)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

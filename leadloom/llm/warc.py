"""WARC archives with revisit resolution.

Writing: payload digests are computed beside the rows, and headers (id, url, digest,
length) are written once. Only they are shuffled by digest: records of digests that occur
more than once are joined to the largest id of their digest and become revisit records,
which carry no payload and so are made from headers alone. Payloads stay where they are;
the rows that are revisited are left out of them by their ids, which are broadcast up to
SMALL rows and joined by a shuffle beyond that. Archives are written by Spark's own text
writer, whose record separator is the CRLF CRLF that ends a WARC record, so its commit
protocol covers lost tasks and any file system that Spark reaches. For that reason a file
is one gzip member, and one warcinfo record tells of the whole archive.

Reading: archives are read as a stream of pieces in the order of each file and cut by
Content-Length, so no more than one record is held at a time, whatever a file's size.
Digests and lengths are taken from the stored payload bytes, and revisit records get
theirs by a join to the response they refer to.

Null html is an empty payload. A null id never takes part in deduplication and is a
response. Rows that repeat both id and payload are all marked alike. Null urls have no
target URI. Payloads of fewer than ``least`` bytes are always responses. An empty table
gives no rows. Columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh_path

#: Fixed values of RFC 4648 and WARC 1.1.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
PER_FILE = 4000
SMALL = 500_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of SHA-1: 10 hex digits make 8 digits to the base 32, whose alphabet is then changed."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in range(1, 40, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _urn(page_id: Column, digest: Column) -> Column:
    x = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(x, 1, 8), F.lit("-"), F.substring(x, 9, 4), F.lit("-"), F.substring(x, 13, 4), F.lit("-"), F.substring(x, 17, 4), F.lit("-"), F.substring(x, 21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; control characters cannot break out of it."""
    safe = F.regexp_replace(value.cast("string"), "[\\x00-\\x1F\\x7F]", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def revisits(headers: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest, refers_to and its url of the records that repeat a payload; from (page_id, url, digest, n)."""
    known = headers.filter(F.col("page_id").isNotNull() & (F.col("n") >= least))
    groups = known.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.min("page_id").alias("lo")).filter("lo < top.page_id")
    groups = durable(groups.select("digest", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url")), "warc-groups")  # so that a hot payload's headers can be split
    found = known.select("page_id", "digest").join(groups, "digest")
    return found.filter("page_id < refers_to").distinct()


def _record(kind: Column, body: Column, date: str) -> Column:
    """The text of a record but its end, from page_id, url, digest, refers_to and refers_url."""
    block = F.concat(F.lit(HTTP_HEAD), body)
    old = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(old, PROFILE)),
        _line("WARC-Refers-To", F.when(old, _urn(F.col("refers_to"), F.col("digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(old, F.col("refers_url"))),
        _line("WARC-Refers-To-Date", F.when(old, F.lit(date))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Refers-To-Page-Id", F.col("refers_to")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2020-01-01T00:00:00Z", per_file: int = PER_FILE) -> None:
    """One record per row of pages (page_id, url, html); date is that of the archive."""
    body = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select("page_id", "url", body.alias("body"), base32_sha1(body.cast("binary")).alias("digest"))
    headers = durable(rows.select("page_id", "url", "digest", F.octet_length("body").alias("n")), "warc-headers")
    again = durable(revisits(headers, least), "warc-revisits")
    gone = again.select("page_id", "digest")
    responses = rows.join(F.broadcast(gone) if gone.count() <= SMALL else gone, ["page_id", "digest"], "left_anti")
    none = {"refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}
    records = responses.withColumns(none).select(_record(F.lit("response"), F.col("body"), date).alias("value"))
    records = records.unionByName(headers.join(again, ["page_id", "digest"]).select(_record(F.lit("revisit"), F.lit(""), date).alias("value")))
    about = "software: leadloom\r\nformat: WARC File Format 1.1\r\n"
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}"
    records = records.unionByName(pages.sparkSession.createDataFrame([(info,)], "value string"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, which comes as what stands between its CRLF CRLFs."""
    held, size, need, head = [], 0, None, {}
    for piece in pieces:
        held += [piece, b"\r\n\r\n"]
        size += len(piece) + 4
        while size and (need is None or size >= need):
            data = b"".join(held)
            if data == b"\r\n\r\n":  # the last piece of a file has no CRLF CRLF behind it if its record's was cut up
                break
            if need is None:
                end = data.index(b"\r\n\r\n")
                head = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
                data, need = data[end + 4 :], int(head["Content-Length"]) + 4
            else:
                if data[need - 4 : need] != b"\r\n\r\n":
                    raise ValueError(f"record {head.get('WARC-Record-ID')} does not end as its Content-Length says")
                yield head, data[: need - 4]
                data, need = data[need:], None
            held, size = [data], len(data)
    if need is not None or (size and b"".join(held) != b"\r\n\r\n"):
        raise ValueError("the file ends within a record")


READ_SCHEMA = "page_id long, url string, record_type string, stated_digest string, payload_digest string, payload_bytes long, refers_to long"
_READ_TYPES = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("stated_digest", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()))
READ_ROWS, READ_BYTES = 5000, 16 << 20


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    pieces = ((f, p) for batch in batches for f, p in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True))
    out, size = [], 0

    def made() -> pa.RecordBatch:
        kinds = _READ_TYPES if with_payload else _READ_TYPES[:-1]
        return pa.record_batch([pa.array([row[i] for row in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    for _, own in itertools.groupby(pieces, key=lambda x: x[0]):
        for h, block in parse_records(p for _, p in own):
            if h["WARC-Type"] not in ("response", "revisit"):
                continue
            payload, old = block.split(b"\r\n\r\n", 1)[1], h["WARC-Type"] == "revisit"
            number = lambda c, h=h: int(h[c]) if c in h else None
            digest = None if old else base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.append((number("X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), digest, None if old else len(payload), number("X-Refers-To-Page-Id"), None if old else payload))
            size += len(payload)
            if len(out) >= READ_ROWS or size >= READ_BYTES:
                yield made()
                out, size = [], 0
    if out:
        yield made()


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record; payload columns of revisit records come from their responses."""
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    schema = READ_SCHEMA + (", payload binary" if with_payload else "")
    rows = pieces.mapInArrow(lambda it: _read(it, with_payload), schema)
    if not with_payload:
        rows = durable(rows, "warc-index")
    more = ["payload"] if with_payload else []
    kept = rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), F.col("payload_bytes").alias("o_bytes"), *[F.col(c).alias(f"o_{c}") for c in more])
    old = rows.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest", *more)
    old = old.join(kept.dropDuplicates(["refers_to", "stated_digest"]), ["refers_to", "stated_digest"], "left")
    old = old.select("page_id", "url", "record_type", "stated_digest", F.col("stated_digest").alias("payload_digest"), F.col("o_bytes").alias("payload_bytes"), "refers_to", *[F.col(f"o_{c}").alias(c) for c in more])
    return rows.filter("record_type = 'response'").select(old.columns).unionByName(old)


def archived_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to fresh archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)

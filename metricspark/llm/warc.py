"""WARC archives in which equal payloads are stored once.

1. ``write_responses`` writes each page as a response record.  Records are binary values of Spark's text
   sink, whose line separator is the empty lines that end a record, so writing goes through Spark's output
   committer and works on any file system that Spark can write.
2. ``deduplicate`` reads the archives' headers only, shuffles these by payload digest, chooses one response
   of each digest as the original and joins every other record of that digest to it.  Then the archives
   are read again, payloads included, and written with fresh headers; a revisit has no payload.
3. ``resolved`` reads archives back and joins each revisit to the response that it refers to.

A digest may stand for a third of all records: digests that stand for more than a share of 1 / HOT of
the rows are at most HOT, and are joined by a broadcast of so many rows; the others by a shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import text as T

#: Records per archive file are set so that a file holds about this many bytes before compression.
FILE_BYTES = 128_000_000
#: Payload bytes in an Arrow batch of the reader (one longer payload is a batch).
BATCH_BYTES = 8_000_000
#: Keys with more than 1 / HOT of all rows are broadcast: there are at most HOT of them.
HOT = 1000
#: WARC-Date of records unless the caller gives another.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"

RECORD = ("file string, offset long, record_type string, record_id string, page_id long, url string, date string, "
          "digest string, payload_bytes long, refers_to string")

_BASE32_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base-32 digits."""
    h = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(h, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*quads)), _BASE32_HEX, _BASE32)


def urn(*parts: Column) -> Column:
    """A record id made of the parts; missing parts are left out."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(df: DataFrame) -> Column:
    """The whole record without the empty lines behind it, of columns ``record_type``, ``record_id``,
    ``page_id``, ``url``, ``date``, ``digest``, ``payload_bytes``, ``refers_to``, ``refers_to_url``,
    ``refers_to_date`` and ``payload`` (left out for a revisit).  Missing headers are left out."""
    def header(name, value):
        return F.concat(F.lit(f"{name}: "), value.cast("string"))

    def address(c):
        return F.regexp_replace(F.col(c), r"[\x00-\x20\x7F]", "%20")

    revisit = F.col("record_type") == "revisit"
    http = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                       header("Content-Length", F.col("payload_bytes")), F.lit("\r\n"))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Date", F.col("date")), header("WARC-Target-URI", address("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, header("WARC-Refers-To", F.col("refers_to"))),
        F.when(revisit, header("WARC-Refers-To-Target-URI", address("refers_to_url"))),
        F.when(revisit, header("WARC-Refers-To-Date", F.col("refers_to_date"))),
        header("X-Page-Id", F.col("page_id")), F.lit("Content-Type: application/http; msgtype=response"),
        header("Content-Length", F.octet_length(http) + F.octet_length(body)), F.lit("\r\n"))
    return F.concat(head.cast("binary"), http.cast("binary"), body).cast("string")


def _write(df: DataFrame, path: str, mean_bytes: float | None) -> None:
    each = max(1, int(FILE_BYTES / (1000 + (mean_bytes or 0))))
    # Compression at the fastest level is half of the work, and a fifth more bytes.
    df.select(record(df).alias("value")).write.mode("overwrite").option("lineSep", END).option(
        "compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", each).text(path)


def write_responses(pages: DataFrame, path: str, date: str = DATE) -> None:
    """One response record per row of ``pages`` (``page_id``, ``url``, ``html``; others are ignored) in
    gzipped files under ``path``.  A missing html is an empty payload; a missing id or url has no header;
    control characters in a url are written as %20, so no value can end its header."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("payload"))
    mean = rows.agg(F.avg(F.octet_length("payload"))).first()[0]
    out = rows.withColumns({
        "record_type": F.lit("response"), "digest": base32_sha1(F.col("payload")), "date": F.lit(date),
        "payload_bytes": F.octet_length("payload").cast("long"),
        **{c: F.lit(None).cast("string") for c in ("refers_to", "refers_to_url", "refers_to_date")}})
    _write(out.withColumn("record_id", urn(F.lit(date), F.col("page_id"), F.col("digest"),
                                           F.monotonically_increasing_id())), path, mean)


def _headers(f) -> dict[str, str]:
    out = {}
    while (line := f.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def parse(content: bytes, name: str = ""):
    """(offset, headers, HTTP headers, payload) of each record of one archive file, gzipped or plain.
    A record that is cut short or does not begin like one raises ValueError."""
    f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while True:
        at, line = f.tell(), f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {at} of {name}")
        head = _headers(f)
        size = int(head["content-length"])
        block = f.read(size)
        if len(block) < size:
            raise ValueError(f"record cut short at {at} of {name}")
        http: dict[str, str] = {}
        if head.get("content-type", "").startswith("application/http"):
            b = io.BytesIO(block)
            b.readline()
            http, block = _headers(b), block[b.tell():]
        yield at, head, http, block


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def records(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """One row per response or revisit record of the archives under ``path`` (columns of RECORD, and
    ``payload`` if asked); records of other types are passed over.

    A response's digest and size are those of the payload that is there.  A revisit has its headers' digest
    and the HTTP header's size."""
    T.prepared(spark)
    schema = f"{RECORD}, payload binary" if payload else RECORD
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for name, content in zip(b.column("path"), b.column("content")):
                file = name.as_py().rsplit("/", 1)[-1]
                for at, head, http, body in parse(content.as_py(), file):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    if kind == "response":
                        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
                    else:
                        digest, size = head.get("warc-payload-digest", "").removeprefix("sha1:") or None, _number(
                            http.get("content-length"))
                    row = [file, at, kind, head.get("warc-record-id"), _number(head.get("x-page-id")),
                           head.get("warc-target-uri"), head.get("warc-date"), digest, size, head.get("warc-refers-to")]
                    rows.append([*row, body] if payload else row)
                    held += 500 + (len(body) if payload else 0)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.types)], schema=fields)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.types)], schema=fields)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema).select(*names)


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and counts the rows of the key in
    ``times``; ``total`` is the number of ``rows``.  Frequent keys are joined by a broadcast of at most HOT
    rows."""
    often = F.col("times") * HOT > total
    frequent, rare = F.broadcast(table.filter(often)), table.filter(~often)
    rest = rows.join(frequent.select(key), key, "left_anti")
    return rows.join(frequent, key).unionByName(rest.join(rare, key))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, date: str = DATE) -> None:
    """Write the archives under ``source`` anew under ``target``, each payload once.

    Of the records with one payload digest and at least ``least`` bytes, the response with the largest page
    id stays one (of equal or missing ids, the last in the archives; a missing id is below all others) and
    the others become revisits of it.  Revisits in ``source`` are pointed to the chosen response; without
    one, they are kept as they are.  All headers are fresh: record ids, dates, lengths and digests."""
    heads = T.written(spark, records(spark, source, payload=False), "warc-heads")
    total = heads.count()
    place = F.struct("page_id", "file", "offset", "record_id", "url")
    groups = T.written(spark, heads.filter(
        F.col("digest").isNotNull() & ((F.col("payload_bytes") >= least) | (F.col("record_type") == "revisit"))).groupBy(
        "digest").agg(F.max(F.when(F.col("record_type") == "response", place)).alias("original"),
                      F.count(F.lit(1)).alias("times")).filter("times > 1 AND original IS NOT NULL"), "warc-groups")
    again = looked_up(heads.select("file", "offset", "digest"), groups, "digest", total).filter(
        "file <> original.file OR offset <> original.offset").select(
        "file", "offset", F.col("original.record_id").alias("to_id"), F.col("original.url").alias("to_url"))
    # Only revisits are in this table; Spark broadcasts it where its files are small enough for that.
    again = T.written(spark, again, "warc-revisits")
    fresh = F.lit(date)
    found = F.col("to_id").isNotNull()
    mean = heads.filter("record_type = 'response'").agg(F.avg("payload_bytes")).first()[0]
    out = records(spark, source, payload=True).join(again, ["file", "offset"], "left").withColumns({
        "record_type": F.when(found, "revisit").otherwise(F.col("record_type")),
        "record_id": urn(fresh, F.col("record_id")), "date": fresh,
        "refers_to": F.when(found, urn(fresh, F.col("to_id"))).otherwise(F.col("refers_to")),
        "refers_to_url": F.col("to_url"), "refers_to_date": F.when(found, fresh)})
    _write(out, target, mean)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of deduplicated archives: ``page_id``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to`` (page id of the response that a revisit is joined to) and ``url``.
    A revisit whose response is not in the archives has its own headers' size and no ``refers_to``."""
    rows = T.written(spark, records(spark, path, payload=False).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "record_id",
        F.col("refers_to").alias("ref"), "url"), "warc-result")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    revisits, responses = rows.filter("record_type = 'revisit'"), rows.filter("record_type = 'response'")
    # What revisits refer to, how many do, and the response if it is there.
    asked = T.written(spark, revisits.filter("ref IS NOT NULL").groupBy("ref").agg(
        F.count(F.lit(1)).alias("times")).join(responses.select(
            F.col("record_id").alias("ref"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full")),
        "ref", "left"), "warc-asked")
    joined = looked_up(revisits, asked, "ref", revisits.count()).withColumn(
        "payload_bytes", F.coalesce("full", "payload_bytes"))
    rest = responses.unionByName(revisits.filter("ref IS NULL")).withColumn("refers_to", F.lit(None).cast("long"))
    return rest.select(*columns).unionByName(joined.select(*columns))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives, deduplicate them and read the result back (see ``resolved``): one row
    per row of ``pages``.  The archives lie in the session's shared folder."""
    spark = pages.sparkSession
    crawl, kept = scratch_path(spark, "warc-crawl"), scratch_path(spark, "warc-deduplicated")
    write_responses(pages, crawl)
    deduplicate(spark, crawl, kept, least)
    return resolved(spark, kept)

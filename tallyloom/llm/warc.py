"""WARC archives: records written in segments, and reassembled from their continuation records.

Writing: a page is a response record whose block is an HTTP message with chunked framing. Of pages with equal payloads of
at least REVISIT bytes, that with the largest page_id is the response and the others are revisit records that refer to
it. Blocks over SEGMENT bytes are split: the first segment is the response record, the others are continuation records
with the origin's id and a segment number, the last of which has the total length. Files hold as many records as make up
FILE_BYTES by the mean size of a record. Records end with two line ends, which Spark's text writer puts between rows.

Reading: files are parsed once, by their Content-Length fields. Segmented records are grouped by origin, ordered by segment
number, and checked to be complete and as long as stated; the group is one record. Blocks are decoded from chunked
framing, and digests are checked. A revisit gets its payload's length from the response that it refers to.

Null html is the empty payload. Rows with a null page_id are responses. Line ends in a url become %0A and %0D. Rows that
are repeated as a whole are records each. Very long payloads are split in segments, and put together in one row. A payload
of many pages has its pages dealt to parts of about SPLIT rows before they meet the page that they refer to. Without pages
the result is empty. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import lean_session, shared_dir, stored

SEGMENT, CHUNK, REVISIT, FILE_BYTES = 32_768, 8_192, 1000, 16 << 20
#: Rows that one part of a frequent payload has, and frequent payloads that are known to all tasks (about 60 bytes each).
SPLIT, SENT = 4096, 1 << 18
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
RECORD = "id string, type string, origin string, segment int, total long, refers_to string, digest string, block binary"


def binary(s: str | Column) -> Column:
    return (F.lit(s) if isinstance(s, str) else s).cast("binary")


def chunked(payload: Column) -> Column:
    """A payload in chunked framing."""
    n = F.ceil(F.octet_length(payload) / CHUNK).cast("int")
    one = lambda i: F.concat(binary(F.concat(F.hex(F.octet_length(F.substring(payload, i * CHUNK + 1, F.lit(CHUNK))).cast("long")), F.lit("\r\n"))), F.substring(payload, i * CHUNK + 1, F.lit(CHUNK)), binary("\r\n"))
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<binary>"))
    return F.concat(F.array_join(parts.cast("array<string>"), "").cast("binary"), binary("0\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(record): each page's records, as the bytes of their head and block, in a string column."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    known = rows.where((F.octet_length("payload") >= REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    known = stored(known, "repeated")
    many = F.broadcast(known.where(F.col("k") > SPLIT).orderBy(F.desc("k"), "digest").limit(SENT).select("digest", F.ceil(F.col("k") / SPLIT).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(many, "digest", "left").withColumn("part", F.pmod(F.hash("page_id", "url"), parts)).drop("parts")
    copies = known.join(many, "digest", "left").select("digest", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = dealt.join(copies, ["digest", "part"], "left").drop("part")
    visited = (F.col("first") != F.col("page_id")) & (F.octet_length("payload") >= REVISIT)
    rows = rows.withColumn("revisit", F.coalesce(visited, F.lit(False)))
    urn = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    block = F.when(F.col("revisit"), binary(HTTP + "\r\n")).otherwise(F.concat(binary(HTTP + "Transfer-Encoding: chunked\r\n\r\n"), chunked(F.col("payload"))))
    rows = rows.select("url", "digest", "revisit", urn(F.col("page_id")).alias("id"), urn(F.col("first")).alias("to"), block.alias("block"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("block") / SEGMENT)).cast("int")
    rows = rows.withColumn("n", n).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("n"))))
    part = F.when(F.col("n") > 1, F.substring(F.col("block"), (F.col("segment") - 1) * SEGMENT + 1, F.lit(SEGMENT))).otherwise(F.col("block"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    when = lambda cond, *cols: F.when(cond, F.concat(*cols)).otherwise(F.lit(""))
    first, many = F.col("segment") == 1, F.col("n") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(~first, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        line("WARC-Record-ID", F.when(first, F.col("id")).otherwise(F.concat(F.expr("substring(id, 1, length(id) - 1)"), F.lit(":"), F.col("segment").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.col("url")),
        when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.lit("Content-Type: application/http;msgtype=response\r\n")),
        when(F.col("revisit"), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.col("to"))),
        when(many, line("WARC-Segment-Number", F.col("segment").cast("string"))), when(~first, line("WARC-Segment-Origin-ID", F.col("id"))),
        when(many & (F.col("segment") == F.col("n")), line("WARC-Segment-Total-Length", F.octet_length("block").cast("string"))),
        line("Content-Length", F.octet_length(part).cast("string")), F.lit("\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), part).cast("string").alias("record"))


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes archives of about FILE_BYTES before compression; gzip runs at its fastest level."""
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("html").cast("string")))).first()
    mean = min((size or 0) / max(n, 1), SEGMENT) + 500  # a record's head has about 500 bytes
    records(pages).write.option("lineSep", END.decode()).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", int(FILE_BYTES / mean)).text(path)


def parsed(content: bytes) -> Iterator[tuple]:
    """The records of a file."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        stop = content.index(END, at)
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(field["content-length"])
        block = content[stop + 4 : stop + 4 + size]
        if len(block) != size or content[stop + 4 + size : stop + 8 + size] != END:
            raise ValueError(f"the record at byte {at} is cut short")
        number, total = field.get("warc-segment-number"), field.get("warc-segment-total-length")
        yield field["warc-record-id"], field["warc-type"], field.get("warc-segment-origin-id"), int(number) if number else None, int(total) if total else None, field.get("warc-refers-to"), field.get("warc-payload-digest", "").removeprefix("sha1:") or None, block
        at = stop + 8 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(RECORD): the records of the archives, segments apart."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from in_batches(parsed(content.as_py()), names, KINDS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def in_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 512) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), kinds)], names)


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[stop + 2 + size : stop + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassembled(parts: DataFrame) -> DataFrame:
    """(id, type, refers_to, digest, block): whole records, from records that are segments. A record with missing parts is an error."""
    joined = parts.groupBy(F.coalesce("origin", "id").alias("id")).agg(
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"), F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("s"), F.count_if(F.col("segment") == 1).alias("copies"),
    )
    block = F.array_join(F.transform("s", lambda x: x["block"].cast("string")), "").cast("binary")
    joined = joined.withColumn("block", block)
    good = (F.element_at("s", -1)["segment"] == F.size("s")) & (F.octet_length("block") == F.col("total")) & F.col("type").isNotNull()
    said = F.raise_error(F.concat(F.lit("segments of "), F.col("id"), F.lit(" are missing"))).cast("binary")
    joined = joined.withColumn("block", F.when(good, F.col("block")).otherwise(said))
    return joined.select("id", "type", "refers_to", "digest", "block", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("copies").cast("int"))))).drop("col")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, refers_to, digest, block): the whole records of archives, segments put together."""
    found = read_warc(spark, path)
    return found.where("segment IS NULL").select("id", "type", "refers_to", "digest", "block").unionByName(reassembled(found.where("segment IS NOT NULL")))


def digested(records_: DataFrame) -> DataFrame:
    """records_ (RECORD) with n and payload_digest of the payloads, checked against the record's digest. Segments keep their block and have neither, others lose it."""
    at = [f.name for f in records_.schema]
    digest, block, kind, segment = at.index("digest"), at.index("block"), at.index("type"), at.index("segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, seen, kept = [], [], []
            for said, raw, t, part in zip(*(batch.column(i).to_pylist() for i in (digest, block, kind, segment))):
                plain = part is None and t != "revisit"
                payload = payload_of(raw) if plain else b""
                own = hashlib.sha1(payload).hexdigest() if plain else said if part is None else None
                if plain and own != said:
                    raise ValueError(f"the digest {said} is not that of its payload")
                sizes.append(len(payload) if plain else None)
                seen.append(own)
                kept.append(None if part is None else raw)
            out = batch.set_column(block, "block", pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sizes, pa.int64()), pa.array(seen, pa.string())], [*out.schema.names, "n", "payload_digest"])

    return records_.mapInArrow(run, StructType([*records_.schema.fields, StructField("n", LongType()), StructField("payload_digest", StringType())]))


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each page, from archives written and read back."""
    spark = pages.sparkSession
    lean_session(spark)
    path = shared_dir(spark, "warc")
    write_warc(pages, path)
    first = stored(digested(read_warc(spark, path)), "records")  # of the blocks only those of segments are kept
    whole = reassembled(first.where("segment IS NOT NULL")).select("id", "type", F.lit(None).cast("string").alias("origin"), F.lit(None).cast("int").alias("segment"), F.lit(None).cast("long").alias("total"), "refers_to", "digest", "block")
    wanted = ("id", "type", F.col("refers_to").alias("to"), "payload_digest", "n")
    got = stored(first.where("segment IS NULL").select(*wanted).unionByName(digested(whole).select(*wanted)), "payloads")
    page = lambda c: F.split_part(c, F.lit(":"), F.lit(3)).try_cast("long")
    own = got.where("type = 'response'").select(page(F.col("id")).alias("page_id"), F.col("n").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    # A response that is referred to may be repeated as a row; a payload's length is one for all that refer to it.
    lengths = got.where("type = 'response'").groupBy(F.col("id").alias("to")).agg(F.max("n").alias("payload_bytes"))
    again = got.where("type = 'revisit'").join(lengths, "to", "left").select(page(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page(F.col("to")).alias("refers_to"))
    return own.unionByName(again)

"""WARC archives with revisit records, written and read through Spark.

Records are written by the text writer with CRLF CRLF as line end, which is what closes a WARC record. Headers (key, digest,
size) are grouped by payload digest; the largest key of a digest becomes the response, the others revisit it and carry no
payload. Payloads are never shuffled by digest: the verdict is worked out on headers and joined to the pages by key. Reading
streams compressed archives, which one task reads from start to end, and closes each record by its Content-Length, so that no
more than a record is held, whatever the size of the file; revisit records are joined to the responses they refer to.

Defined cases: a null payload is empty; a null url is written as urn:none; rows that repeat the key of a response are responses
as well; rows with a null key are read back with a null key, and refer to or serve others only if no row of their digest has
a key; an empty table gives an empty archive; more columns are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from decision_lens.functions.joins import join_hot
from decision_lens.llm.textkit import quoted
from decision_lens.session import scratch_dir, stage

CLOSE = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MIN_BYTES = 0
ROWS_A_FILE = 20_000

HEADER = T.StructType([T.StructField(n, t) for n, t in [
    ("record_id", T.StringType()), ("record_type", T.StringType()), ("page_key", T.StringType()), ("target_uri", T.StringType()),
    ("payload_digest", T.StringType()), ("refers_to_id", T.StringType()), ("payload_bytes", T.LongType()), ("computed_digest", T.StringType())]])
RECORD = T.StructType([*HEADER.fields, T.StructField("payload", T.BinaryType())])


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: 160 bits are 32 groups of five, taken from four runs of ten hex digits."""
    digits = F.sha1(payload)
    parts = []
    for i in range(4):
        run = F.conv(F.substring(digits, 10 * i + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(BASE32), F.shiftright(run, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def pages_of(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    body = F.coalesce(quoted(payload).cast("string"), F.lit("")).alias("body")
    one = pages.select(quoted(key).cast("string").alias("key"), quoted(key).alias("order"), F.coalesce(quoted(url), F.lit("urn:none")).alias("url"), body)
    return one.withColumn("sha", F.sha1(F.col("body").cast("binary"))).withColumn("size", F.octet_length("body").cast("long"))


def resolved(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages with record_type and the key of the response that they revisit. Only headers are shuffled by digest."""
    heads = pages.select("key", "order", "sha", "size").where(F.col("size") >= min_bytes)
    last = heads.groupBy("sha", "size").agg(F.max(F.struct("order", "key")).alias("last"), F.count(F.lit(1)).alias("copies"))
    last = last.where("copies > 1").select("sha", "size", F.col("last.key").alias("first_key"))
    again = heads.join(last, ["sha", "size"]).where(~F.col("key").eqNullSafe(F.col("first_key")))
    again = again.select(F.col("key").alias("key_"), F.col("sha").alias("sha_"), F.col("size").alias("size_"), "first_key").distinct()
    p = pages.join(again, F.col("key").eqNullSafe(F.col("key_")) & (F.col("sha") == F.col("sha_")) & (F.col("size") == F.col("size_")), "left")
    return p.select("key", "url", "body", "size", F.when(F.col("sha_").isNotNull(), "revisit").otherwise("response").alias("record_type"),
                    F.when(F.col("sha_").isNotNull(), F.col("first_key")).alias("refers_to"))


def record_id(key: Column, digest: Column) -> Column:
    d = F.md5(F.concat_ws(" ", key, digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 4),
                    F.lit("-"), F.substring(d, 17, 4), F.lit("-"), F.substring(d, 21, 12), F.lit(">"))


def written_now() -> Column:
    """The time of the query in UTC, the same for all of its records."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record(p: DataFrame, date: str | None = None) -> Column:
    digest, line = base32_sha1(F.col("body").cast("binary")), lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))).otherwise("")
    again = F.col("record_type") == "revisit"
    http = F.lit(HTTP)
    content = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    safe_url = F.regexp_replace("url", "[\\r\\n]", " ")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("key"), digest)),
        line("WARC-Date", written_now() if date is None else F.lit(date)), line("WARC-Target-URI", safe_url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Profile", F.when(again, PROFILE)), line("WARC-Refers-To", F.when(again, record_id(F.col("refers_to"), digest))),
        line("X-Page-Key", F.col("key")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(content).cast("string")), F.lit("\r\n"), content)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES,
                   rows_a_file: int = ROWS_A_FILE, compression: str = "gzip", date: str | None = None) -> None:
    """Deduplicated archives in a new folder, dated now unless a date is given. A file holds rows_a_file records at most."""
    p = resolved(pages_of(pages, key, url, payload), min_bytes)
    (p.select(record(p, date).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", rows_a_file)
     .option("compression", compression).text(path))


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a byte stream that comes in pieces."""
    source, held, at = iter(pieces), bytearray(), 0

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        del held[:at]
        at = 0
        if not held and not more():
            return
        while (end := held.find(CLOSE)) < 0:
            if not more():
                raise ValueError(f"no header ends after {bytes(held[:40])!r}")
        lines = bytes(held[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at {lines[0][:40]!r}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        start = end + len(CLOSE)
        stop = start + int(fields["content-length"])
        at = stop + len(CLOSE)
        while len(held) < at and more():
            pass
        if held[stop:at] != CLOSE:
            raise ValueError(f"record {fields.get('warc-record-id')} is not closed")
        yield fields, bytes(held[start:stop])


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives below a folder; payload=False leaves the payloads out, after their digests are computed.

    Compressed archives (.gz) may have any size. Plain ones can be cut anywhere by the reader, so they are read whole, as files of less than 2 GB.
    """
    packed = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").option("lineSep", CLOSE.decode())
              .text(path).select(F.col("value").cast("binary").alias("content")))
    plain = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*[!z]").load(path).select("content"))
    schema = RECORD if payload else HEADER

    def records(streams):
        import base64
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        rows, held = [], 0
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        for stream in streams:
            for fields, block in parsed(stream):
                body = block.partition(CLOSE)[2]
                computed = base64.b32encode(hashlib.sha1(body).digest()).decode()
                digest = fields.get("warc-payload-digest")
                rows.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("x-page-key"), fields.get("warc-target-uri"),
                             digest.removeprefix("sha1:") if digest else None, fields.get("warc-refers-to"), len(body), computed, body)[:len(arrow)])
                held += len(body)
                if held > 8 << 20 or len(rows) == 10_000:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    def of_lines(batches):
        # the reader took the closing bytes off each line
        yield from records([(value.as_py() + CLOSE for b in batches for value in b.column(0))])

    def of_files(batches):
        yield from records([value.as_py()] for b in batches for value in b.column(0))

    return packed.mapInArrow(of_lines, schema).unionAll(plain.mapInArrow(of_files, schema))


def with_originals(records: DataFrame, key_type: str = "long") -> DataFrame:
    """One row per record: key, type, size and digest of the full payload, and the key of the response of a revisit.

    Headers are staged, so that the archives are read once; a response that a large share of the revisits refers to is sent to them.
    """
    heads = stage(records.select(HEADER.names))
    own = heads.where("record_type IS DISTINCT FROM 'revisit'")
    responses = heads.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("page_key").alias("original_key"), F.max("payload_bytes").alias("original_bytes"), F.max("computed_digest").alias("original_digest"))
    again = join_hot(heads.where("record_type = 'revisit'"), responses, "refers_to_id", "left")
    row = lambda size, digest, other: (F.col("page_key").cast(key_type).alias("page_id"), F.col(size).alias("payload_bytes"),
                                       F.col(digest).alias("payload_digest"), "record_type", other.cast(key_type).alias("refers_to"))
    return own.select(*row("payload_bytes", "computed_digest", F.lit(None))).unionAll(
        again.select(*row("original_bytes", "original_digest", F.col("original_key"))))


def archive_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"

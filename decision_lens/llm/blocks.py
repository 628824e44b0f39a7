"""Texts in compressed blocks, written once and joined with answers without moving them again.

Blocks are a table bucketed by ``part``, one part for each input partition. Answers for a part are shuffled to its bucket, and a
grouped function sees the blocks of a part beside them. A part holds what one input partition holds. Work is done on one block
at a time, but blocks stand in chunks, and a chunk sends one message to a bucket: the number of messages is the product of the numbers
of chunks and of buckets, so both are to be as large as memory allows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from decision_lens.llm.textkit import quoted, slices
from decision_lens.session import scratch_dir

BLOCK_BYTES = 1 << 20
CHUNK_BYTES = 16 << 20
MAX_PARTS = 50_000
CODEC = pa.Codec("zstd", compression_level=1)
NO_ID = np.iinfo(np.int64).max


def squeezed(raw: bytes) -> bytes:
    """Compressed bytes after their number."""
    return struct.pack("<q", len(raw)) + CODEC.compress(raw, asbytes=True)


def raw_size(blob) -> int:
    return struct.unpack_from("<q", blob)[0]


def restored(blob) -> memoryview:
    blob = memoryview(blob)
    return memoryview(CODEC.decompress(blob[8:], decompressed_size=raw_size(blob)))


def packed(ids: list[int | None], texts: list[bytes]) -> bytes:
    head = np.array([len(t) for t in texts], dtype=np.int64).tobytes()
    known = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64).tobytes()
    return squeezed(struct.pack("<q", len(texts)) + head + known + b"".join(texts))


def unpacked(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bounds and bytes of the texts of a block."""
    raw = restored(blob)
    n = struct.unpack_from("<q", raw)[0]
    sizes = np.frombuffer(raw, dtype=np.int64, count=n, offset=8)
    ids = np.frombuffer(raw, dtype=np.int64, count=n, offset=8 + 8 * n)
    return ids, np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(raw, dtype=np.uint8, offset=8 + 16 * n)


DATA = pa.schema([("data", pa.list_(pa.binary()))])


def several(blobs) -> list:
    """A chunk's blocks; a block alone is a chunk of one."""
    return [blobs] if isinstance(blobs, bytes) else blobs


def blocks_of(docs: DataFrame, key: str, text: str, form: Callable = lambda blobs: (blobs,), schema: pa.Schema = DATA, ddl: str = "data array<binary>") -> DataFrame:
    """(part, chunk, data): texts in blocks of about BLOCK_BYTES, one text at least, in chunks of about CHUNK_BYTES; a null text is empty.

    ``form`` makes the columns of ``schema``, in place of data, from a chunk's packed blocks.
    """
    spark = docs.sparkSession
    slim = docs.select(quoted(key).cast("long").alias("id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("body"))
    n = max(1, min(MAX_PARTS, slim.rdd.getNumPartitions()))
    # a value for each bucket, so that every part has a bucket of its own
    values = {r["b"]: r["v"] for r in spark.range(20 * n + 50).select(F.col("id").cast("int").alias("v")).groupBy(
        F.pmod(F.hash("v"), F.lit(n)).alias("b")).agg(F.min("v").alias("v")).collect()}

    def run(batches):
        from pyspark import TaskContext
        partition = TaskContext.get().partitionId()
        part, number, blobs, size = values.get(partition % n, partition % n), partition << 32, [], 0
        for batch in batches:
            for rows in slices(batch, 1, BLOCK_BYTES):
                if rows.num_rows:
                    blobs.append(packed(rows.column(0).to_pylist(), rows.column(1).cast(pa.large_binary()).to_pylist()))
                    size += raw_size(blobs[-1])
                if size >= CHUNK_BYTES:
                    yield from table_of([(part, number, *form(blobs))], whole).to_batches()
                    number, blobs, size = number + 1, [], 0
        if blobs:
            yield from table_of([(part, number, *form(blobs))], whole).to_batches()

    whole = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *schema])
    name = f"blocks_{uuid.uuid4().hex}"
    (slim.mapInArrow(run, f"part int, chunk long, {ddl}").write.bucketBy(n, "part").sortBy("part")
     .option("path", f"{scratch_dir(spark).rstrip('/')}/staged/{name}").saveAsTable(name))
    return spark.table(name)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)}, schema=schema)


def blobs_of(chunk) -> list:
    return [x.as_buffer() for x in chunk.values]


def each_chunk(blocks: DataFrame, fn: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that fn(part, chunk, blocks) yields for every chunk."""
    def run(batches):
        for batch in batches:
            for part, number, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows = list(fn(part, number, blobs_of(chunk)))
                if rows:
                    yield from table_of(rows, schema).to_batches()

    return blocks.select("part", "chunk", "data").mapInArrow(run, ddl)


def each_chunk_with(blocks: DataFrame, answers: DataFrame, fn: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that fn(part, chunk, blocks, rows) yields for every chunk; rows are the chunk's (bucket, answer)."""
    def run(left, right):
        found: dict[int, list] = {}
        for number, bucket, answer in zip(right.column("chunk").to_pylist(), right.column("bucket").to_pylist(), right.column("answer").to_pylist()):
            found.setdefault(number, []).append((bucket, answer))
        made = [table_of([], schema)]
        for part, number, chunk in zip(left.column("part").to_pylist(), left.column("chunk").to_pylist(), left.column("data").combine_chunks()):
            rows = list(fn(part, number, blobs_of(chunk), found.get(number, [])))
            if rows:
                made.append(table_of(rows, schema))
        return pa.concat_tables(made)

    return blocks.groupBy("part").cogroup(answers.select("part", "chunk", "bucket", "answer").groupBy("part")).applyInArrow(run, ddl)


def each_bucket(sent: DataFrame, fn: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that fn(bucket, rows) yields for the rows (part, chunk, a, b) of every bucket."""
    def run(t):
        rows = list(zip(*(t.column(c).to_pylist() for c in ("part", "chunk", "a", "b"))))
        return table_of(list(fn(t.column("bucket")[0].as_py(), rows)), schema)

    return sent.groupBy("bucket").applyInArrow(run, ddl)


SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
SENT_DDL = "part int, chunk long, bucket long, a binary, b binary"
ANSWERED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])
ANSWERED_DDL = "part int, chunk long, bucket long, answer binary"

"""Whole UTF-8 texts as numpy arrays: bounded slices of Arrow batches, word spans, mixed 64-bit hashes.

Hashes are polynomials over prefix sums in 64-bit arithmetic, so that the hash of any byte range costs two look-ups.
Callers that need certainty compare the bytes behind equal hashes.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


SPACED = byte_table(b" \t\n\x0b\x0c\r")
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def importable(spark: SparkSession) -> None:
    """Let Python workers find this library where it is not installed: its folder joins their search path."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def fresh(names, wanted: str) -> str:
    """A column name that is not in use."""
    while wanted in names:
        wanted += "_"
    return wanted


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the hash of the first i bytes; see ``range_hash``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of all bytes with a blank after each text, and where each text starts and ends. Null is empty."""
    texts = [t or b"" for t in texts]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + 1) - 1
    return np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8), ends - sizes, ends


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = range_hash(prefix_hash(data), starts, ends)
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words by its first word's position."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - n + 1
    h = words[:size].copy()
    for j in range(1, n):
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h += words[j:j + size]
    return mixed(h)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, one row at least."""
    col = batch.column(column)
    sizes = np.array([0 if v is None else v for v in pc.binary_length(col).to_pylist()], dtype=np.int64)
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would hold on to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(col: pa.Array) -> list[bytes | None]:
    return col.cast(pa.large_binary()).to_pylist()


def map_texts(df: DataFrame, text: str, fields: list[StructField], fn: Callable[[list], list], keep: list[str] | None = None,
              limit: int = SLICE_BYTES, with_rows: tuple[str, ...] = (), drop_text: bool = False) -> DataFrame:
    """Append columns that ``fn`` derives from a bounded list of whole texts.

    fn gets the texts as bytes, then the columns named in ``with_rows``; it returns a list of values or an array per field.
    Columns of the input with the name of a new field are replaced.
    """
    names = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names and not (drop_text and c == text)]
    inner = fresh(keep + names, "text_")
    more = [fresh(keep + names, f"row_{i}_") for i in range(len(with_rows))]
    source = df.select(*[quoted(c) for c in keep], quoted(text).cast("string").alias(inner),
                       *[quoted(c).alias(m) for c, m in zip(with_rows, more)])
    schema = StructType([f for f in source.schema.fields if f.name in keep] + list(fields))
    n = len(keep)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(StructType(list(fields)))
        for batch in batches:
            for part in slices(batch, n, limit):
                if not part.num_rows:
                    continue
                made = fn(as_bytes(part.column(n)), *[part.column(n + 1 + i).to_pylist() for i in range(len(with_rows))])
                new = [pa.array(v, type=f.type) for v, f in zip(made, arrow)]
                del made
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], names=[*keep, *names])
                del new
        batch = part = None
        give_back()

    return source.mapInArrow(run, schema)

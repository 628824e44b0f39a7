"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text (a shift and an addition per byte, so it depends on the last 8 bytes). A chunk
ends where the hash is less than at the REACH bytes on either side, so ends depend on near-by content alone and an insertion
moves none but its neighbours. Chunks are compared by 64-bit digest (a false match joins or makes a run only next to true ones, or if the
chunk alone is long enough). A chunk is removed if it also occurs in a document with a smaller id, within a run of such chunks that
holds MIN_WORDS words or more: short phrases and notices stay. WORD_BYTES bytes count as a word at least, for texts without blanks. A
text that is the same as a whole text with a smaller id goes whole, whatever its length.

Only digests and ids are shuffled for the comparison, one row per document and digest, once. Of a slice of texts only the least id
asks about a digest: the others of the slice are known to repeat it and are dealt by id, so a digest that is in every text holds a
row a slice. The digests that repeat come back to the documents, whose chunks are cut again, from the same bytes, to remove runs.

Defined cases: null texts stay null, empty ones empty; rows with a null id neither lose nor take text; rows of one id are one
document and do not take from each other; repeated rows change alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from decision_lens.llm.textkit import SPACED, fresh, joined, map_texts, quoted, word_spans

GEAR = np.random.default_rng(1903).integers(0, 1 << 32, 256, dtype=np.uint32)
HISTORY = 8
REACH = 8
MAX_CHUNK = 8192
MIN_WORDS = 20
WORD_BYTES = 8
NEVER = np.uint32(0xFFFFFFFF)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the last 8 bytes at each byte, by doubling: a window of 2k bytes is two windows of k."""
    h, size = GEAR[data], 1
    while size < HISTORY:
        wide = h.copy()
        wide[size:] += h[:-size] << np.uint32(2 * size)
        h, size = wide, 2 * size
    return h


def least_before(h: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ``reach`` values before each place."""
    m, size = h.copy(), 1
    while size * 2 <= reach:
        m[size:] = np.minimum(m[size:], m[:-size])
        size *= 2
    rest = reach - size
    if rest:
        m[rest:] = np.minimum(m[rest:], m[:-rest])
    out = np.full_like(h, NEVER)
    out[1:] = m[:-1]
    return out


def chunks(texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All bytes, and for each text the bounds of its chunks in them, from its start to its end."""
    data, starts, ends = joined(texts)
    if not len(data):
        return data, []
    h = gear(data)
    # the first bytes of a text must not depend on the text before it
    head = (starts[:, None] + np.arange(HISTORY - 1)).ravel()
    h[head[head < len(h)]] = NEVER
    h[ends] = NEVER
    before, after = least_before(h, REACH), least_before(h[::-1], REACH)[::-1]
    cuts = np.flatnonzero((h < before) & (h < after)) + 1
    where = np.searchsorted(cuts, np.stack([starts, ends], axis=1), side="right")
    out = []
    for s, e, (a, b) in zip(starts.tolist(), ends.tolist(), where.tolist()):
        inner = cuts[a:b]
        bounds = np.concatenate([[s], inner[inner < e], [e]])
        if len(bounds) > 1 and np.diff(bounds).max() > MAX_CHUNK:
            bounds = np.unique(np.concatenate([bounds, *[np.arange(x, y, MAX_CHUNK) for x, y in zip(bounds[:-1], bounds[1:]) if y - x > MAX_CHUNK]]))
        out.append(bounds if e > s else bounds[:1])
    return data, out


def digest(piece: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)


def whole_digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, person=b"text").digest(), "little", signed=True)


def digests(texts: list[bytes | None]) -> list:
    """Of each text, its distinct chunks and, last, the whole of it."""
    data, bounds = chunks(texts)
    raw = data.tobytes()
    return [[[*{digest(raw[x:y]): None for x, y in zip(b[:-1].tolist(), b[1:].tolist())}, *([whole_digest(t)] if t else [])] for t, b in zip(texts, bounds)]]


def asked_and_known(texts: list[bytes | None], ids: list) -> list:
    """Digests of each text that no smaller id of the list holds, and those that one does."""
    every, least = digests(texts)[0], {}
    for own, i in zip(every, ids):
        for d in own:
            if d not in least or i < least[d]:
                least[d] = i
    return [[[d for d in own if not least[d] < i] for own, i in zip(every, ids)], [[d for d in own if least[d] < i] for own, i in zip(every, ids)]]


def removed(texts: list[bytes | None], known: list, min_words: int) -> list:
    """Rest of each text, its chunks, and the byte ranges that were removed (flat)."""
    data, bounds = chunks(texts)
    raw = data.tobytes()
    rest, count, spans = [], [], []
    for t, b, repeats in zip(texts, bounds, known):
        count.append(len(b) - 1)
        flat: list[int] = []
        if repeats:
            repeats = set(repeats)
            runs: list[list[int]] = []
            all_of_it = bool(t) and whole_digest(t) in repeats
            for x, y in zip(b[:-1].tolist(), b[1:].tolist()):
                if all_of_it or digest(raw[x:y]) in repeats:
                    if runs and runs[-1][1] == x:
                        runs[-1][1] = y
                    else:
                        runs.append([x, y])
            flat = [v - int(b[0]) for x, y in runs if all_of_it or max(len(word_spans(data[x:y], SPACED)[0]), (y - x) // WORD_BYTES) >= min_words for v in whole(raw, x, y, int(b[-1]))]
        spans.append(flat)
        if t is None or not flat:
            rest.append(t)
        else:
            parts, at = [], 0
            for x, y in zip(flat[0::2], flat[1::2]):
                parts.append(t[at:x])
                at = y
            rest.append(b"".join([*parts, t[at:]]))
    return [[None if r is None else r.decode(errors="replace") for r in rest], count, spans]


def whole(raw: bytes, x: int, y: int, end: int) -> tuple[int, int]:
    """A range drawn in to whole UTF-8 characters."""
    while x < y and raw[x] & 0xC0 == 0x80:
        x += 1
    while y > x and y < end and raw[y] & 0xC0 == 0x80:
        y -= 1
    return x, y


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Documents with the rest of their text, n_chunks and removed_spans (byte ranges of the text as it was, flat)."""
    keep = docs.columns if carry is None else [*dict.fromkeys([*carry, text])]
    slim = docs.where(quoted(key).isNotNull()).select(quoted(key).alias("id"), quoted(text).alias("body"))
    plain = isinstance(slim.schema["id"].dataType, (T.IntegralType, T.StringType))  # Python orders these as Spark does
    fields = [T.StructField(name, T.ArrayType(T.LongType())) for name in ("asked", "known")]
    pieces = map_texts(slim, "body", fields, lambda texts, ids: asked_and_known(texts, ids if plain else [0] * len(ids)), drop_text=True, with_rows=("id",))
    # a row that is known to repeat meets no other: its lot is its own
    lots = F.array(F.struct(F.lit(0).cast("long").alias("lot"), F.col("asked").alias("digests")), F.struct(F.xxhash64("id").bitwiseOR(F.lit(1).cast("long")).alias("lot"), F.col("known").alias("digests")))
    pieces = pieces.select("id", F.explode(lots).alias("of")).select("id", "of.lot", F.explode("of.digests").alias("digest"))
    first = F.min("id").over(Window.partitionBy("digest", "lot"))
    inner, repeats, rest = (fresh(docs.columns, name) for name in ("id_", "repeats_", "rest_"))
    again = pieces.withColumn("first", first).where("lot <> 0 OR first < id").groupBy(F.col("id").alias(inner)).agg(F.collect_set("digest").alias(repeats))
    df = docs.join(again, quoted(key) == F.col(inner), "left").drop(inner)
    fields = [T.StructField(rest, T.StringType()), T.StructField("n_chunks", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.LongType()))]
    out = map_texts(df, text, fields, lambda texts, known: removed(texts, known, min_words), keep=keep, with_rows=(repeats,))
    new = F.col(rest)
    cols = [new.alias(c) if c == text else F.when(F.size("removed_spans") > 0, F.length(new).cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars"
            else quoted(c) for c in keep if c not in ("n_chunks", "removed_spans")]
    return out.select(*cols, "n_chunks", "removed_spans")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of docs, with repeated runs cut out of the text and n_chars to match."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row_"), quoted(key).alias("id_of_row_"), quoted(text).cast("string").alias("body_of_row_"))
    out = deduplicated(rows, "id_of_row_", "body_of_row_", carry=["row_"], **options)
    own = {text: F.col("body_of_row_"), "n_chars": F.length("body_of_row_").cast("long")}
    field = lambda c: F.col("row_")[c]
    return out.select(*[(F.when(F.size("removed_spans") > 0, own[c]).otherwise(field(c)) if c in own else field(c)).alias(c) for c in docs.columns])

"""Hard-negative mining: exact score windows over Hilbert-ordered blocks with zone maps.

For every anchor the 5 best rows of its label are its positives; for each positive the best rows of other labels whose score is
between 80 and 100 % of the positive's score are its negatives. Scores are integer inner products of floor(256 * x).

Vectors are put in the order of a Hilbert curve through all dimensions, dealt out by ranges of it and packed into blocks of
BLOCK_ROWS rows, each with the least and greatest component per dimension and the labels inside (its zone map), written as Parquet.
An anchor's score with any row of a block lies within the interval sum(min(a*lo, a*hi)) .. sum(max(a*lo, a*hi)). Both searches first
read the anchor's own range of the curve, which gives each anchor the score that it must beat; the intervals then choose the
blocks that can still hold better rows, and only these blocks are sent to the anchors of a pack. Nothing is approximate.

Anchors of neighbouring ranges form packs; zone maps are read in pages, so neither they nor the anchors are ever held whole. A vector
that a third of all rows share fills many blocks, as ranges are cut by (curve, id).

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors count as padded
with zeros; a null id is never an anchor, takes its label as it stands and comes after every other id; repeated rows are rows of their
own, and a repeated anchor has results of its own, its copy among its positives; an empty table gives an empty result; scores beyond 64 bits
are an error; further columns are not carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from decision_lens.llm.blocks import NO_ID
from decision_lens.llm.textkit import quoted
from decision_lens.session import stage

BLOCK_ROWS = 256
RANGE_ROWS, MOST_ROWS, RANGES = 4096, 1 << 16, 64
PACKS, PACK_RANGES = 16, 64
PAGE_RANGES = 16
BITS = 4
ANCHORS = 1024
BEST = 5
LOW, HIGH = 80, 100
NONE = np.iinfo(np.int64).min


def integers(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): rows that take part, components as whole numbers."""
    v = F.transform(quoted(vector).cast("array<double>"), lambda x: F.floor(x * 256))
    fine = F.forall(quoted(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(quoted(label).isNotNull() & quoted(vector).isNotNull() & fine).select(
        quoted(vec_id).cast("long").alias("vec_id"), quoted(label).cast("long").alias("label"), v.cast("array<long>").alias("v"))


def edges(v: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Least and greatest component of every dimension, and the number of rows: a row per dimension reaches the driver."""
    def run(batches):
        for batch in batches:
            wide = padded(batch.column(0))
            if wide.size:
                lo, hi = wide.min(axis=0), wide.max(axis=0)
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(lo)), pa.int32()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    found = v.select("v").mapInArrow(run, "i int, lo long, hi long").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    found.sort(key=lambda r: r["i"])
    lo, hi = (np.array([r[c] for r in found], dtype=np.int64) for c in ("lo", "hi"))
    # a shorter vector is padded with zeros
    return np.minimum(lo, 0), np.maximum(hi, 0), v.count()


def padded(col: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column as a matrix, short ones filled up with zeros."""
    sizes = np.asarray(pa.compute.list_value_length(col))
    flat = np.asarray(pa.compute.list_flatten(col)).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place on the Hilbert curve of every row of whole numbers below 2**bits, as bytes that sort alike."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest bit
        p = np.uint32(q - 1)
        for i in range(n):
            flip = (x[i] & q) != 0
            other = np.where(flip, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(flip, p, other).astype(np.uint32)
            if i:
                x[i] ^= other
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= turn
    plane = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)  # bits, dimensions, rows
    packed = np.packbits(plane.reshape(bits * n, -1).T, axis=1)
    return [r.tobytes() for r in packed]


def exact_type(lo: np.ndarray, hi: np.ndarray):
    """The narrowest type in which every inner product is exact."""
    most = float(np.sum(np.maximum(np.abs(lo.astype(float)), np.abs(hi.astype(float))) ** 2))
    if most >= 2.0 ** 63:
        raise ValueError("inner products of these vectors exceed 64 bits")
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64


BLOCK_DDL = "range int, block long, n int, ids binary, labels binary, data binary, lo binary, hi binary"


def blocks(v: DataFrame, lo: np.ndarray, hi: np.ndarray, n: int) -> DataFrame:
    """Staged blocks in the order of the curve, with their zone maps."""
    width = len(lo)
    small = np.int16 if max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)) < 1 << 15 else np.int64
    span = np.maximum((hi - lo).astype(float), 1.0)

    def keyed(batches):
        for batch in batches:
            wide = padded(batch.column(2), width)
            cells = np.minimum((wide - lo) / span * (1 << BITS), (1 << BITS) - 1).astype(np.int64) if width else np.zeros((len(wide), 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in wide.astype(small)], pa.binary()),
                                              pa.array(hilbert_keys(cells), pa.binary())], names=["vec_id", "label", "data", "curve"])

    ranges = max(1, -(-n // min(max(n // RANGES, RANGE_ROWS), MOST_ROWS)))
    order = v.mapInArrow(keyed, "vec_id long, label long, data binary, curve binary")
    order = order.repartitionByRange(ranges, "curve", F.xxhash64("vec_id", "label")).sortWithinPartitions("curve", "vec_id", "label")

    def cut(batches):
        from pyspark import TaskContext
        at, rest, number = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while rest.num_rows >= BLOCK_ROWS:
                yield one(at, number, rest.slice(0, BLOCK_ROWS))
                rest, number = rest.slice(BLOCK_ROWS), number + 1
        if rest is not None and rest.num_rows:
            yield one(at, number, rest)

    def one(at, number, t):
        data = np.frombuffer(b"".join(t.column("data").to_pylist()), dtype=small).reshape(t.num_rows, width)
        ids = np.asarray(t.column("vec_id").fill_null(NO_ID)).astype(np.int64)
        row = {"range": at, "block": (at << 32) + number, "n": t.num_rows, "ids": ids.tobytes(), "labels": np.asarray(t.column("label")).astype(np.int64).tobytes(),
               "data": data.tobytes(), "lo": data.min(axis=0).astype(np.int64).tobytes(), "hi": data.max(axis=0).astype(np.int64).tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("range", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *[
            (c, pa.binary()) for c in ("ids", "labels", "data", "lo", "hi")]]))

    return stage(order.mapInArrow(cut, BLOCK_DDL))


class Block:
    """Rows of a block in the type of exact products."""

    def __init__(self, row: dict, width: int, small, exact):
        self.n, self.block = row["n"], row["block"]
        self.ids, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
        self.data = np.frombuffer(row["data"], dtype=small).reshape(self.n, width).astype(exact)
        self.places = (self.block << 16) + np.arange(self.n)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every anchor with any row of every block, by interval arithmetic."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


class Found:
    """Best rows of every (anchor, slot): at most BEST each, pruned whenever enough have gathered."""

    def __init__(self, floors: np.ndarray):
        self.floor = floors  # (anchors, slots): scores below cannot matter any more
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, anchor, slot, score, ids, place):
        self.parts.append(np.stack([anchor, slot, score, ids, place]))
        self.size += len(anchor)
        if self.size > 20_000 + 4 * BEST * self.floor.size:
            self.prune()

    def prune(self) -> np.ndarray:
        rows = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((5, 0), dtype=np.int64)
        order = np.lexsort((rows[4], rows[3], -rows[2], rows[1], rows[0]))
        rows = rows[:, order]
        key = rows[0] * self.floor.shape[1] + rows[1]
        first = np.searchsorted(key, key)
        rank = np.arange(len(key)) - first
        full = rank == BEST - 1
        self.floor[rows[0][full], rows[1][full]] = np.maximum(self.floor[rows[0][full], rows[1][full]], rows[2][full])
        rows = rows[:, rank < BEST]
        self.parts, self.size = [rows], rows.shape[1]
        return rows


def scan(pack: dict, block: Block, anchors: np.ndarray, found: Found, positives: bool) -> None:
    """Add the block's rows that still matter for the anchors numbered ``anchors``; a slot is a positive's window."""
    for i in range(0, len(anchors), ANCHORS):
        at = anchors[i:i + ANCHORS]
        score = (pack["data"][at] @ block.data.T).astype(np.int64)
        alike, floor = pack["labels"][at][:, None] == block.labels[None, :], found.floor[at]
        if positives:
            a, b = np.nonzero(alike & (score >= floor) & (pack["places"][at][:, None] != block.places[None, :]))
            found.add(at[a], np.zeros(len(a), dtype=np.int64), score[a, b], block.ids[b], block.places[b])
            continue
        top = pack["high"][at]
        a, b = np.nonzero(~alike & (score >= floor.min(axis=1)[:, None]) & (score <= top.max(axis=1)[:, None]))
        s = score[a, b]
        for slot in range(top.shape[1]):
            fits = (s <= top[a, slot]) & (s >= floor[a, slot])
            found.add(at[a[fits]], np.full(int(fits.sum()), slot), s[fits], block.ids[b[fits]], block.places[b[fits]])


def pack_of(rows: list[dict], width: int, small, exact) -> dict:
    """Anchors as arrays; ``floor`` and ``high`` bound the scores that matter, by slot."""
    number = lambda c: np.array([r[c] for r in rows], dtype=np.int64)
    return {"places": number("place"), "labels": number("label"), "floor": np.array([r["floor"] for r in rows], dtype=np.int64), "high": np.array([r["high"] for r in rows], dtype=np.int64),
            "data": np.frombuffer(b"".join(bytes(r["data"]) for r in rows), dtype=small).reshape(len(rows), width).astype(exact)}


HIT = pa.schema([("place", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("found_id", pa.int64()), ("found_place", pa.int64())])
HIT_DDL = "place long, slot int, score long, found_id long, found_place long"


def hits(pack: dict, found: Found) -> pa.Table:
    a, slot, score, ids, place = found.prune()
    return pa.Table.from_arrays([pa.array(pack["places"][a]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(ids), pa.array(place)], schema=HIT)


def search(anchors: DataFrame, stored: DataFrame, ranges: int, width: int, small, exact, positives: bool) -> DataFrame:
    """Best rows for every (anchor, slot). anchors: place, range, pack, label, data, floor and high (arrays by slot)."""
    def own(left, right):
        rows = left.to_pylist()
        if not rows or not right.num_rows:
            return pa.Table.from_batches([], schema=HIT)
        pack = pack_of(rows, width, small, exact)
        found, everyone = Found(pack["floor"].copy()), np.arange(len(rows))
        for row in each(right):
            scan(pack, Block(row, width, small, exact), everyone, found, positives)
        return hits(pack, found)

    def each(table):
        for i in range(table.num_rows):
            yield table.slice(i, 1).to_pylist()[0]

    body = stored.select("range", "block", "n", "ids", "labels", "data")
    near = stage(anchors.groupBy("range").cogroup(body.groupBy("range")).applyInArrow(own, HIT_DDL))
    # what an anchor must beat in each slot, after its own range
    full = near.groupBy("place", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(f"n >= {BEST}")
    floors = full.groupBy(F.col("place").alias("p_")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("got"))
    raised = F.transform("floor", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("got", i.cast("int")), x)))
    wanted = stage(anchors.join(floors, F.col("place") == F.col("p_"), "left").select("place", "range", "pack", "label", "data", raised.alias("floor"), "high"))

    pages = -(-ranges // PAGE_RANGES)
    zones = stored.select("range", "block", "labels", "lo", "hi", F.floor(F.col("range") / PAGE_RANGES).cast("int").alias("page"))
    asked = wanted.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(max(pages - 1, 0)))))

    def choose(left, right):
        rows, zone = left.to_pylist(), right.to_pylist()
        out: list[tuple] = []
        if rows and zone:
            pack = pack_of(rows, width, small, exact)
            lo, hi = (np.stack([np.frombuffer(z[c], dtype=np.int64) for z in zone]) for c in ("lo", "hi"))
            lo, hi = (x.astype(object if exact is np.int64 else np.float64) for x in (lo, hi))
            homes, inside = np.array([z["range"] for z in zone]), [np.unique(np.frombuffer(z["labels"], dtype=np.int64)) for z in zone]
            mine, many = np.array([r["range"] for r in rows]), np.array([len(x) > 1 for x in inside])
            kinds, which = np.unique(pack["labels"], return_inverse=True)
            has = np.stack([np.isin(kinds, x) for x in inside], axis=1)  # labels of anchors by blocks
            chosen_at: list[list[np.ndarray]] = [[] for _ in zone]
            for i in range(0, len(rows), ANCHORS):
                part = slice(i, i + ANCHORS)
                least, most = bounds(pack["data"][part].astype(lo.dtype), lo, hi)
                need = np.zeros(least.shape, dtype=bool)
                for slot in range(pack["floor"].shape[1]):
                    need |= (most >= pack["floor"][part, slot][:, None]) & (least <= pack["high"][part, slot][:, None])
                need &= mine[part][:, None] != homes[None, :]
                need &= has[which[part]] if positives else ~has[which[part]] | many[None, :]
                for j in np.flatnonzero(need.any(axis=0)):
                    chosen_at[j].append(pack["places"][part][need[:, j]])
            out = [(rows[0]["pack"], z["range"], z["block"], np.concatenate(at).tobytes()) for z, at in zip(zone, chosen_at) if at]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                    names=["pack", "range", "block", "places"])

    chosen = stage(paged(asked, zones, choose))

    def read(left, right):
        rows = left.to_pylist()
        if not rows or not right.num_rows:
            return pa.Table.from_batches([], schema=HIT)
        pack = pack_of(rows, width, small, exact)
        order = np.argsort(pack["places"])
        found = Found(pack["floor"].copy())
        for row in each(right):
            at = order[np.searchsorted(pack["places"][order], np.frombuffer(row["places"], dtype=np.int64))]
            scan(pack, Block(row, width, small, exact), at, found, positives)
        return hits(pack, found)

    sent = body.drop("range").join(chosen, "block")
    cells = chosen.select(F.col("pack").alias("at_pack"), F.col("range").alias("at_range")).distinct()
    there = wanted.join(cells, F.col("pack") == F.col("at_pack"))
    far = there.groupBy("at_pack", "at_range").cogroup(sent.groupBy("pack", "range")).applyInArrow(read, HIT_DDL)
    best = Window.partitionBy("place", "slot").orderBy(F.desc("score"), "found_id", "found_place")
    return near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(f"rank <= {BEST}")


def paged(asked: DataFrame, zones: DataFrame, choose) -> DataFrame:
    """Every pack beside every page of zone maps."""
    packs = asked.select(F.col("pack").alias("to_pack"), F.col("page").alias("to_page")).distinct()
    sent = zones.join(packs, F.col("page") == F.col("to_page"))
    return asked.groupBy("page", "pack").cogroup(sent.groupBy("to_page", "to_pack")).applyInArrow(
        choose, "pack int, range int, block long, places binary")


def mined(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors whose id is divisible by ``every``."""
    v = stage(integers(rows, vec_id, vector, label))
    lo, hi, n = edges(v)
    width, exact = len(lo), exact_type(lo, hi)
    small = np.int16 if max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)) < 1 << 15 else np.int64
    stored = blocks(v, lo, hi, n)
    ranges = (stored.agg(F.max("range").alias("m")).first()["m"] or 0) + 1
    a_pack = min(max(1, ranges // PACKS), PACK_RANGES)

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
                data = np.frombuffer(row["data"], dtype=small).reshape(row["n"], width)
                at = np.flatnonzero((ids != NO_ID) & (ids % every == 0))
                if len(at):
                    yield pa.RecordBatch.from_pydict({
                        "place": pa.array((row["block"] << 16) + at), "range": pa.array([row["range"]] * len(at), pa.int32()), "pack": pa.array([row["range"] // a_pack] * len(at), pa.int32()),
                        "vec_id": pa.array(ids[at]), "label": pa.array(labels[at]), "data": pa.array([data[i].tobytes() for i in at], pa.binary())})

    anchors = stage(stored.select("range", "block", "n", "ids", "labels", "data").mapInArrow(
        pick, "place long, range int, pack int, vec_id long, label long, data binary"))
    first = anchors.drop("vec_id").withColumn("floor", F.array(F.lit(int(NONE)).cast("long"))).withColumn("high", F.array(F.lit(NO_ID).cast("long")))
    best = stage(search(first, stored, ranges, width, small, exact, True).select("place", "rank", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a window for every positive that can have one; slots count from 0
    least = F.expr(f"(positive_score * {LOW} + {HIGH - 1}) div {HIGH}")
    slots = best.where("positive_score >= 0").groupBy(F.col("place").alias("p_")).agg(F.array_sort(F.collect_list(F.struct("rank", least.alias("floor"), F.col("positive_score").alias("high")))).alias("w"))
    second = anchors.drop("vec_id").join(slots, F.col("place") == F.col("p_")).select("place", "range", "pack", "label", "data", "w")
    empty = F.struct(F.lit(NO_ID).cast("long").alias("floor"), F.lit(int(NONE)).cast("long").alias("high"))
    w = F.transform(F.sequence(F.lit(1), F.lit(BEST)), lambda r: F.coalesce(F.get(F.transform(F.filter("w", lambda x: x["rank"] == r), lambda x: F.struct(x["floor"].alias("floor"), x["high"].alias("high"))), F.lit(0)), empty))
    second = stage(second.select("place", "range", "pack", "label", "data", F.transform(w, lambda x: x["floor"]).alias("floor"), F.transform(w, lambda x: x["high"]).alias("high")))
    negatives = search(second, stored, ranges, width, small, exact, False)
    out = negatives.select("place", (F.col("slot") + 1).alias("slot"), F.col("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(best.select("place", F.col("rank").alias("slot"), "positive_id", "positive_score"), ["place", "slot"]).join(anchors.select("place", F.col("vec_id").alias("anchor_id")), "place")
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")

"""Near-duplicate documents by SuperMinHash, banding, verification on full shingle sets, and union-find grouping.

Signature: in round j every element of a set draws a number in [j, j + 1) and, by a Fisher-Yates shuffle of its own, a slot it has
not drawn before; a slot keeps the least number. Numbers of later rounds are greater, so a document stops as soon as all slots are
filled: large sets take one round, a set of one element takes as many rounds as there are slots.

Documents with equal sets are one class, represented by their least id. Representatives that share a band key are candidates.
Bands of ROWS = 4 of 128 slots miss a pair of similarity 0.8 with probability (1 - 0.8^4)^32 = 5e-8. Pairs are not listed within a
key: every member is first tried against the least member of its keys, the most similar first. Only keys whose members are
still in different components are looked at again: their members' sketches are compared in numpy, in blocks of BLOCK members at most, and
a group returns no more pairs than tie its parts together, the most alike first (from turn to turn twice as many between two
parts). These are confirmed; those that are no links are left out of the next turn, until no candidate joins two components.
Candidates of a set size ratio below the limit (which rules them out), with a signature agreement more than 4.5 standard
deviations below it, or whose similarity is below the limit by the lower 16 bits of all shingle hashes (an upper bound, for sets of
FINE at most, so it loses none) are dropped. All others are confirmed on their full sets of 64-bit hashes.

Defined cases: null and empty texts have no shingles and no links; a text of fewer words than a shingle is one shingle of all
its words; rows of one id are one document and share a component; rows with a null id have a null component and are kept;
repeated rows change nothing; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from decision_lens.llm.graph import components
from decision_lens.llm.textkit import LOWER, SPACED, fresh, give_back, joined, map_texts, mixed, ngram_hashes, quoted, word_hashes, word_spans
from decision_lens.session import stage

SLOTS, ROWS = 128, 4
SHINGLE, PERCENT = 5, 80
BLOCK = 4096
FINE = 2048
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

FIELDS = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
          T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, _, ends = joined(texts)
    low = LOWER[data]
    starts, stops = word_spans(low, SPACED)
    words = word_hashes(low, starts, stops)
    cut = np.searchsorted(starts, ends)
    grams, out, first = ngram_hashes(words, n), [], 0
    for last in cut.tolist():
        if last - first >= n:
            out.append(np.unique(grams[first:last - n + 1]))
        elif last > first:
            out.append(ngram_hashes(words[first:last], last - first) ^ np.uint64(last - first))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        first = last
    return out


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: one row of ``slots`` numbers, round in the upper and draw in the lower 32 bits."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    sig = np.full(len(sets) * slots, EMPTY)
    order = None
    for j in range(slots):
        if not len(element):
            break
        r = mixed(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = j + ((r >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot, first_pick = pick, pick
        else:
            if order is None:  # shuffles begin only for the sets that one round doesn't fill
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(element), 1))
                row = np.arange(len(element))
                order[row, first_pick] = 0
                order[:, 0] = first_pick
            row = np.arange(len(element))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, j]
            order[:, j] = slot
        np.minimum.at(sig, doc * slots + slot, np.uint64(j << 32) | (r & np.uint64(0xFFFFFFFF)))
        open_ = (sig.reshape(-1, slots) == EMPTY).any(axis=1)[doc]
        if not open_.all():
            doc, element = doc[open_], element[open_]
            if order is None:
                first_pick = first_pick[open_]
            else:
                order = order[open_]
    return sig.reshape(-1, slots)


def sketched(texts: list[bytes | None], n: int) -> list:
    sets = shingle_sets(texts, n)
    sig = signatures(sets)
    keys = np.zeros((len(sets), SLOTS // ROWS), dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(31) + sig[:, r::ROWS] + np.uint64(r))
    keys = mixed(keys + np.arange(SLOTS // ROWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    short = (mixed(sig) & np.uint64(255)).astype(np.uint8)
    size = [len(s) for s in sets]
    return [size, [set_key(s) for s in sets], [x.tobytes() for x in short],
            [k if z else k[:0] for k, z in zip(keys.view(np.int64), size)]]


def elements_of(texts: list[bytes | None], n: int) -> list:
    """Key, elements and (for sets of FINE at most) the lower 16 bits of the elements of each text's set."""
    sets = shingle_sets(texts, n)
    return [[set_key(s) for s in sets], [s.tobytes() for s in sets], [s.astype(np.uint16).tobytes() if len(s) <= FINE else b"" for s in sets]]


def set_key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def least_agreement(percent: int) -> float:
    share = percent / 100
    return (share - 4.5 * (share * (1 - share) / SLOTS) ** 0.5) * SLOTS


def agreeing(pairs: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b, sketches and sizes) that may reach the limit, with the slots that agree."""
    least = least_agreement(percent)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            same = (left == right).sum(axis=1)
            pick = np.flatnonzero(same >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pick)), b.column(1).take(pa.array(pick)), pa.array(same[pick].astype(np.int64))],
                                             names=["a", "b", "same"])

    near = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return near.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, same long")


def tied(node: np.ndarray, part: np.ndarray, size: np.ndarray, sketch: np.ndarray, block: np.ndarray, fine: list[np.ndarray], failed: list[np.ndarray],
         percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that tie all candidates of the nodes together: between two parts up to ``most`` of the most alike, as if each were a link.

    A node is compared with those before it. Of every other part that holds candidates, only the most alike one is needed, since
    the parts are one from then on; it must pass the bound by short hashes and must not have ``failed`` before. Where the nodes are of two
    blocks, only pairs across them count: pairs within a block have a group of their own.
    """
    least, across = least_agreement(percent), len(np.unique(block)) > 1
    order = np.lexsort((node, part))
    node, part, size, sketch, block = node[order], np.unique(part[order], return_inverse=True)[1], size[order], sketch[order], block[order]
    fine, (known, place) = [fine[i] for i in order], np.unique(node, return_inverse=True)
    bad = [np.zeros(0, dtype=np.int64)]
    for x, i in enumerate(order):
        other = known[np.isin(known, failed[i])] if len(failed[i]) else ()
        if len(other):
            at = np.searchsorted(known, other)
            bad.append(np.minimum(at, place[x]) * len(known) + np.maximum(at, place[x]))
    bad = np.unique(np.concatenate(bad))
    held, found = np.zeros(1 << 16, dtype=bool), [np.zeros((2, 0), dtype=np.int64)]
    for x in range(1, len(node)):
        fits = (part[:x] != part[x]) & (100 * np.minimum(size[x], size[:x]) >= percent * np.maximum(size[x], size[:x]))
        if across:
            fits &= block[:x] != block[x]
        y = np.flatnonzero(fits)
        if not len(y):
            continue
        same = (sketch[y] == sketch[x]).sum(axis=1)
        y, same = y[same >= least], same[same >= least]
        if len(bad) and len(y):
            code = np.minimum(place[y], place[x]) * len(known) + np.maximum(place[y], place[x])
            new = bad[np.minimum(np.searchsorted(bad, code), len(bad) - 1)] != code
            y, same = y[new], same[new]
        if not len(y):
            continue
        own = fine[x]
        held[own] = True
        by = np.lexsort((node[y], -same, part[y]))
        y = y[by]
        borders = np.flatnonzero(np.concatenate([[True], part[y][1:] != part[y][:-1], [True]]))
        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
            chosen = []
            for other in y[lo:hi].tolist():
                both = int(held[fine[other]].sum()) if len(own) and len(fine[other]) else -1
                if both < 0 or 100 * both >= percent * (size[x] + size[other] - both):
                    chosen.append(other)
                    if len(chosen) == most:
                        break
            if chosen:
                found.append(np.stack([np.full(len(chosen), node[x]), node[chosen]]))
                part[part == part[chosen[0]]] = part[x]
        held[own] = False
    a, b = np.concatenate(found, axis=1)
    return np.minimum(a, b), np.maximum(a, b)


def unlinked(members: DataFrame, percent: int, most: int) -> DataFrame:
    """Candidates (a, b) among the members (key, node, c, n_shingles, sketch, fine, failed) of one key that tie its components c together."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    m = members.join(counts.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    m = m.select("key", "node", "c", "n_shingles", "sketch", "fine", "failed", "block", F.explode(pairs).alias("p"))

    def run(t):
        import pyarrow as pa
        n, c, s, k = (t.column(x).to_numpy() for x in ("node", "c", "n_shingles", "block"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)
        fine = [np.frombuffer(x or b"", dtype=np.uint16) for x in t.column("fine").to_pylist()]
        failed = [np.array(x or [], dtype=np.int64) for x in t.column("failed").to_pylist()]
        a, b = tied(n, c, s, sketch, k, fine, failed, percent, most)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    m = m.select("key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "node", "c", "n_shingles", "sketch", "fine", "failed", "block")
    return m.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["u", "v"])
        b = x = y = None
        give_back()

    held = (pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("e_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("elements").alias("e_b")), "b"))
    return held.select("a", "b", "e_a", "e_b").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id reachable), kept (the id is that least id)."""
    slim = docs.select(quoted(key).alias("id"), quoted(text).alias("body"))
    sk = stage(map_texts(slim, "body", FIELDS, lambda texts: sketched(texts, shingle), drop_text=True))
    linked = sk.where("id IS NOT NULL AND n_shingles > 0")
    reps = linked.groupBy("set_key").agg(F.min("id").alias("node"))
    nodes = stage(linked.join(reps.withColumnRenamed("set_key", "k"), (F.col("set_key") == F.col("k")) & (F.col("id") == F.col("node")))
                  .select("node", "n_shingles", "set_key", "sketch", "bands").dropDuplicates(["node", "set_key"]))
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").drop("high")
    members = stage(members.join(shared, "key").select("key", "node", "low").distinct())
    facts = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "n_shingles", "set_key", "sketch")
    facts = stage(facts)

    def candidates(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        for side in "ab":
            pairs = pairs.join(facts.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
        return agreeing(pairs, percent).distinct()

    first = stage(candidates(members.select(F.col("low").alias("a"), F.col("node").alias("b"))))
    best = first.groupBy("b").agg(F.max_by("a", "same").alias("a")).select("a", "b")
    # full sets of all members of shared keys: their texts are read once more
    wanted = members.select(F.col("node").alias("id")).distinct()
    fields = [FIELDS[1], T.StructField("elements", T.BinaryType()), T.StructField("fine", T.BinaryType())]
    sets = stage(map_texts(slim.join(wanted, "id"), "body", fields, lambda texts: elements_of(texts, shingle), drop_text=True).withColumnRenamed("id", "node"))
    fine = sets.select("node", "set_key", "fine").dropDuplicates(["node", "set_key"])
    # rows of one id are one document, so the classes of its texts belong together
    own = sk.where("id IS NOT NULL").join(reps, "set_key").select(F.col("id").alias("u"), F.col("node").alias("v")).where("u <> v")
    several = own.join(linked.groupBy(F.col("id").alias("u")).agg(F.count_distinct("set_key").alias("c")).where("c > 1"), "u", "left_semi")
    links = stage(confirmed(best, sets, percent).unionAll(several.select("u", "v")).distinct())
    tried, turn, most = best, "first", 1
    while True:
        comp = stage(components(links))
        part = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))  # noqa: E731, B023
        if turn == "first":
            more = first.select("a", "b").join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
        else:
            # pairs that were confirmed to be no link must not tie parts together again; the greater id keeps them, so the least
            # member of a large key, which many were tried against, holds no list
            no = tried.join(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), ["a", "b"], "left_anti")
            no = no.groupBy(F.col("b").alias("node")).agg(F.collect_set("a").alias("failed"))
            m = members.select("key", "node").join(comp, "node", "left").join(facts.join(fine, ["node", "set_key"]), "node").join(no, "node", "left")
            more = unlinked(m.withColumn("c", F.coalesce("component", "node")).drop("component"), percent, most)
            most *= 2
        more = stage(more.select("a", "b").join(tried, ["a", "b"], "left_anti"))
        if turn != "first" and more.isEmpty():
            break
        turn, tried = "next", stage(tried.unionAll(more))
        links = stage(links.unionAll(confirmed(more, sets, percent)).distinct())
    comp = components(links)
    of_set = reps.join(comp, "node", "left").select("set_key", F.coalesce("component", "node").alias("of_set"))
    out = sk.join(of_set, "set_key", "left")
    return out.select("id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("of_set")), F.col("id")).alias("component_id")).select(
        F.col("id").alias(key), "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents without those that are near copies of one with a smaller id. Rows of an id that stays all stay."""
    name = fresh(docs.columns, "gone_id_")
    gone = groups(docs, key, text, **options).where("NOT kept").select(F.col(key).alias(name)).distinct()
    return docs.join(gone, quoted(key) == F.col(name), "left_anti")

"""Pair statistics by both routes against brute force over all pairs."""

import itertools
import json
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from decision_lens.operators import similarity as S


def data(n=90):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        p = 0 if i < n // 3 else i // 6  # one prediction holds a third of the rows
        v = [rnd.gauss(0, 1) for _ in range(5)]
        if i in (40, 41):
            v = [0.0] * 5
        rows.append((i, f"p{p}", i % 3, None if p % 5 == 4 else p % 3, f"g{i % 2}", "declined" if p % 2 else "approved", v))
    rows.append((n, "alone", 0, 1, "g9", "approved", [1.0] * 5))
    return rows


SCHEMA = "vec_id long, prediction_id string, regeneration_number int, cluster_id int, llm_name string, outcome string, embedding array<double>"


def brute(rows):
    def unit(v):
        v = np.array(v)
        n = np.linalg.norm(v)
        return v / n if n else v
    out = {}
    for a, b in itertools.combinations(rows, 2):
        cos = float(unit(a[6]) @ unit(b[6]))
        names = ["random_baseline"]
        if a[1] == b[1] and a[2] != b[2]:
            names.append("same_instance")
        if a[1] != b[1] and a[3] is not None and b[3] is not None:
            names.append("intra_cluster" if a[3] == b[3] else "inter_cluster")
        groups = [("overall", "*", "*")]
        if a[4] == b[4]:
            groups.append(("by_llm", a[4], "*"))
        if a[5] == b[5]:
            groups.append(("by_outcome", "*", a[5]))
        if a[4] == b[4] and a[5] == b[5]:
            groups.append(("by_llm_outcome", a[4], a[5]))
        for g in groups:
            for c in names:
                out.setdefault((*g, c), []).append(cos)
    return out


@pytest.mark.parametrize("hot,block,ranked", [(4096, 2048, 100_000), (8, 16, 3), (40, 2048, 5)])
def test_pair_stats(spark, hot, block, ranked):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if hot == 4096 else 7)
    rows = data()
    df = S.unit(spark.createDataFrame(rows, SCHEMA)).cache()
    want = brute(rows)
    got = {(r["grouping"], r["llm_name"], r["outcome"], r["pair_class"]): r for r in S.moment_stats(df, hot).collect()}
    assert ("by_llm", "g9", "*", "random_baseline") not in got  # a single row has no pairs
    for k, r in got.items():
        v = want.get(k, [])
        assert r["count"] == len(v)
        if v:
            assert r["mean"] == pytest.approx(np.mean(v), abs=1e-12) and r["std"] == pytest.approx(np.std(v), abs=1e-9)
        else:
            assert r["mean"] is None and r["std"] is None
    ordered = S.order_stats(S.grouped(df), S.GROUP, block_rows=block, ranked_values=ranked).collect()
    assert len(ordered) == len(want)
    for r in ordered:
        v = want[tuple(r[c] for c in (*S.GROUP, "pair_class"))]
        assert (r["median"], r["min"], r["max"]) == pytest.approx((np.median(v), min(v), max(v)), abs=1e-12)
    for r in S.pair_stats(df, block, hot, ranked).collect():  # all groupings in one grid
        v = want.get(tuple(r[c] for c in (*S.GROUP, "pair_class")), [])
        assert (r["median"], r["min"], r["max"]) == (pytest.approx((np.median(v), min(v), max(v)), abs=1e-12) if v else (None, None, None))


def block(seed, idx, n=1024, paths=None):
    u = np.random.default_rng(seed).normal(size=(n, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    numbers = {"p": np.arange(n) // 6 + n * idx, "r": np.arange(n) % 3, "c": np.arange(n) % 5 - 1}
    return S._Block({"n": n, "home": "{}", "idx": idx, "ks": ["{}", "{}"], "data": u.tobytes(), "centre": u.mean(axis=0).tobytes(), "radius": 1.0, "paths": paths,
                     **{c: x.astype(np.int64).tobytes() for c, x in numbers.items()}})


@pytest.mark.parametrize("values", [False, True])
def test_counts_of_blocks_take_bounded_memory(values):
    chosen = json.dumps([{"view": v, "pair_class": c, "target": t, "path": [{"low": -1.0, "width": 2.0, "chosen": 2048 + t}]}
                         for v in (0, 1) for c in ("random_baseline", "intra_cluster") for t in (0, 1)])
    a, b = block(1, 0, paths=chosen if values else None), block(2, 1, paths=chosen if values else None)
    dots, intra = a.u @ b.u.T, (a.c[:, None] >= 0) & (a.c[:, None] == b.c)
    counts = S._Counts(["random_baseline", "intra_cluster"], values)
    tracemalloc.start()
    for _ in range(3):
        counts.add(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    if not values:
        assert all(sum(x.nbytes for x in kept if isinstance(x, np.ndarray)) <= 8 * S.BINS for kept in counts.found.values())
    table = counts.table().to_pandas()
    for name, v in (("random_baseline", dots.ravel()), ("intra_cluster", dots[intra])):
        own = table[(table["pair_class"] == name) & (table["view"] == 1) & (table["target"] == 1)].sort_values(["bin", "lo"])
        bins = np.floor((v + 1) / 2 * 4096).astype(int)
        if values:
            assert own["n"].sum() == 3 * (bins == 2049).sum() and np.allclose(np.repeat(own["lo"], own["n"] // 3), np.sort(v[bins == 2049]), atol=1e-15)
        else:
            want = np.bincount(bins, minlength=4096) * 3
            assert own["bin"].tolist() == np.flatnonzero(want).tolist() and own["n"].tolist() == want[want > 0].tolist()
            assert own["lo"].iloc[0] == pytest.approx(v.min(), abs=1e-15) and own["hi"].iloc[0] == pytest.approx(v.max(), abs=1e-15)


def test_hierarchy_and_consistency(spark):
    stats = spark.createDataFrame([("overall", "*", "*", c, 5, m, s) for c, m, s in (
        ("same_instance", 0.9, 0.1), ("intra_cluster", 0.8, 0.1), ("inter_cluster", 0.5, 0.1), ("random_baseline", 0.4, 0.2))],
        "grouping string, llm_name string, outcome string, pair_class string, count long, mean double, std double")
    assert S.consistency(stats).first()["consistency"] == pytest.approx(1.5)
    r = S.hierarchy(stats).first()
    assert r["order_correct"] and r["ranking"][0] == "same_instance"
    flat = stats.withColumn("std", F.lit(0.0))
    assert S.consistency(flat).first()["consistency"] is None

"""Turn repair, hard negatives and posting lists against brute force, with odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from decision_lens.llm import hard_negatives, posting_lists, turn_repair

SF = "/root/testdata/sf0.01"


def by_states(kinds, faults):
    """Least (cost, audit) by a walk over the states of the grammar, one row at a time."""
    after = {"e": [("", "e"), ("I", "u"), ("II", "a")], "s": [("", "s"), ("I", "u"), ("II", "a")], "u": [("", "u"), ("I", "a")], "a": [("", "a"), ("I", "u")]}
    now = {s: (2 * len(i), i) for i, s in after["e"]}
    for kind, fault in zip(kinds, faults):
        then = {}
        for state, (cost, audit) in now.items():
            steps = [(state, 3, "D")]
            if fault not in (1, 2):
                cut = int(fault == 3)
                if (state, kind) in (("e", 0), ("e", 1), ("s", 1), ("a", 1), ("u", 2)):
                    steps.append(("sua"[kind], cut, "K"))
                steps.append(("a" if state == "u" else "u", 2 + cut, "R"))
            for to, more, op in steps:
                for ins, end in after[to]:
                    found = (cost + more + 2 * len(ins), audit + op + ins)
                    then[end] = min(then.get(end, found), found)
        now = then
    return min(v for s, v in now.items() if s in "ea")


@pytest.mark.parametrize("cells", [1, 4 << 20])
def test_alignment_is_the_cheapest_and_least(monkeypatch, cells):
    monkeypatch.setattr(turn_repair, "CELLS", cells)  # 1: the table is kept in parts
    turn_repair.aligned.cache_clear()
    r = random.Random(cells)
    for _ in range(1500):
        n = r.randint(0, 12)
        kinds, faults = tuple(r.choice([0, 1, 2, 1, 2, 3]) for _ in range(n)), tuple(r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert turn_repair.aligned(kinds, faults) == by_states(kinds, faults), (kinds, faults)
    kinds = tuple(r.choice([1, 2]) if r.random() < 0.1 else 1 + i % 2 for i in range(600))
    faults = tuple(r.choice([1, 2, 3]) if r.random() < 0.1 else 0 for _ in kinds)
    assert turn_repair.aligned(kinds, faults) == by_states(kinds, faults)
    turn_repair.aligned.cache_clear()


CONV = "conv_id long, turn long, role string, text string, place string, fault string, block string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], CONV)


def test_repair_of_odd_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (2, None, "user", None), (2, 3, None, "x."), (3, 0, "tool", "A."), (3, 9, "user", "long. " * 20_000),
            (None, 0, "assistant", "B."), (4, 0, "system", "S."), (5, 0, "system", "S."), (5, 1, "user", "Why"), (5, 2, "assistant", "Ok!"), (6, 0, "user", "\n \t"), (7, 0, "", "R.")]
    df = conversations(spark, rows)
    turns = turn_repair.judged(df)
    found = turn_repair.audits(turns)
    got = {r["conv_id"]: r for r in turn_repair.digests(df, turns, found).collect()}
    assert {c: (r["audit"], r["cost"]) for c, r in got.items()} == {1: ("KKD", 3), 2: ("DD", 6), 3: ("RR", 4), None: ("IK", 2), 4: ("D", 3), 5: ("KKK", 1), 6: ("D", 3), 7: ("D", 3)}
    assert got[1]["duplicate"] == 1 and got[2]["blank"] == 1 and got[3]["gaps"] == 8 and got[5]["truncated"] == 1 and got[1]["illegal"] == 1
    fixed = sorted((str(r["conv_id"]), r["at"], r["row"], r["role"]) for r in turn_repair.repaired(turns, found).collect() if r["conv_id"] in (3, None))
    assert fixed == [("3", 0, 1, "user"), ("3", 1, 2, "assistant"), ("None", 0, None, "user"), ("None", 1, 1, "assistant")]
    none = df.limit(0)
    turns = turn_repair.judged(none)
    assert turn_repair.digests(none, turns, turn_repair.audits(turns)).count() == 0


def test_long_conversation_keeps_its_order(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}." if i % 7 else "Same.") for i in range(3000)]
    random.Random(1).shuffle(rows)
    turns = turn_repair.judged(conversations(spark, rows)).collect()
    assert all(t["place"] == t["turn"] + 1 for t in turns)
    assert sum(t["fault"] == 2 for t in turns) == sum(i % 7 == 0 for i in range(3000)) - 2  # the first of either role stays


def test_damage_leaves_conversations_without_rows(spark):
    rows = [(i, 0, "user", "Gone.") for i in range(60)]
    df = conversations(spark, rows)
    turns = turn_repair.judged(turn_repair.damaged(df))
    got = turn_repair.digests(df, turns, turn_repair.audits(turns)).collect()
    empty = [r for r in got if r["audit"] == ""]
    assert len(got) == 60 and empty and all(r["cost"] == 0 and r["repaired_sha256"].startswith("e3b0c442") for r in empty)


VECTORS = "vec_id long, embedding array<float>, label int, place string, list string, range string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", "mine", "mine") for r in rows], VECTORS)


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(12, d))[r.integers(0, 12, n)] + 0.2 * r.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_hilbert_curve_moves_one_step_at_a_time():
    for n, bits in ((2, 3), (3, 2), (2, 4)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = hard_negatives.hilbert_keys(grid, bits)
        walk = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
        assert len(set(keys)) == len(grid) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    r = np.random.default_rng(3)
    rows, anchors = r.integers(-200, 200, (40, 6)).astype(float), r.integers(-200, 200, (9, 6)).astype(float)
    least, most = hard_negatives.bounds(anchors, rows.min(axis=0)[None, :], rows.max(axis=0)[None, :])
    scores = anchors @ rows.T
    assert (scores >= least).all() and (scores <= most).all()


def mined_by_hand(rows, every):
    rows = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)), y) for i, v, y in rows]
    out = []
    for n, (a, x, y) in enumerate(rows):
        if a % every:
            continue
        scores = sorted(((-int(x @ v), i, z) for m, (i, v, z) in enumerate(rows) if m != n))
        for p, pid, _ in [s for s in scores if s[2] == y][:5]:
            fits = [s for s in scores if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "RANGE_ROWS", 300)
    x = clustered(3000, 8, 5)
    x[1000:2000] = x[1000]  # a third of all rows are one vector
    rows = [(i, x[i].tolist(), i % 3) for i in range(3000)]
    got = hard_negatives.mined(vectors(spark, rows), every=100).collect()
    assert sorted(tuple(r) for r in got) == mined_by_hand(rows, 100)


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "RANGE_ROWS", 512)
    x = clustered(6000, 4, 7)
    sent = []
    paged = hard_negatives.paged
    monkeypatch.setattr(hard_negatives, "paged", lambda *a: sent.append(paged(*a)) or sent[-1])
    v = vectors(spark, [(i, x[i].tolist(), i % 2) for i in range(6000)])
    hard_negatives.mined(v, every=500).collect()
    read = sum(len(r["places"]) // 8 for r in sent[0].collect())
    assert 0 < read < 0.7 * 12 * (6000 / hard_negatives.BLOCK_ROWS)


ODD = [(0, None, 1), (7, [1.0, None], 1), (14, [float("nan"), 1.0], 1), (21, [float("inf"), 0.0], 2), (100, [1.0, 0.5], None), (None, [0.9, 0.1], 1), (200, [0.5, 0.5], 1), (200, [0.5, 0.5], 1),
       (1, [0.5, 0.5], 2), (2, [0.5, 0.4], 2), (3, [0.5], 2), (4, [], 1), (300, [0.0, 0.0], 1)]


def test_hard_negatives_of_odd_rows(spark):
    got = sorted((tuple(r) for r in hard_negatives.mined(vectors(spark, ODD)).collect()), key=str)
    # both rows of 200 have the other one and the row without an id as positives; the zero vector scores 0 with everything
    twice = [(200, 200, 1, 1, 32768, 32768), (200, 200, 2, 2, 32768, 29440), (200, None, 1, 2, 32640, 29440)]
    zeros = [(300, p, k, k, 0, 0) for p in (4, 200, 200, None) for k in (1, 2, 3)]
    assert got == sorted(2 * twice + zeros, key=str)
    assert hard_negatives.mined(vectors(spark, [])).count() == 0
    assert hard_negatives.mined(vectors(spark, [(100, [], 1), (200, [], 2)])).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mined(vectors(spark, [(100, [1e30], 1), (200, [1e30], 2)])).count()


def neighbours(rows):
    known = {}
    for r in rows:
        known.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in known.items()}


@pytest.mark.parametrize("same", [False, True])
def test_posting_lists_find_the_neighbours(spark, monkeypatch, same):
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 64)
    monkeypatch.setattr(posting_lists, "PART_ROWS", 100)
    r = np.random.default_rng(1)
    x = (r.normal(size=(2000, 16)) * r.uniform(0.5, 2, (2000, 1))).astype(np.float32)  # lengths differ
    if same:
        x[500:1200] = x[500]
    got = neighbours(posting_lists.searched(vectors(spark, [(i, x[i].tolist(), 0) for i in range(2000)])).collect())
    assert sorted(got) == list(range(0, 2000, 20))
    hit, wide = [], x.astype(float)
    for q, found in got.items():
        s = (wide * wide[q]).sum(axis=1)
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] != q and abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda t: (-t[1], t[0]))
        s[q] = -np.inf
        best = np.lexsort((np.arange(2000), -s))[:20]
        hit.append(np.mean([s[f[1]] >= s[best[-1]] - 1e-12 for f in found]))
    assert np.mean(hit) >= 0.9


def test_posting_lists_of_odd_rows(spark):
    got = neighbours(posting_lists.searched(vectors(spark, ODD)).collect())
    # 200 stands twice, each row finds the other; zero, null and broken vectors take no part
    assert sorted(got) == [100, 200]
    assert [f[1] for f in got[100]] == [200, 200, 1, 2, None, 3] or [f[1] for f in got[100]][0] is None
    assert {f[1] for f in got[200]} == {100, None, 200, 1, 2, 3} and len(got[200]) == 2 * 6
    assert posting_lists.searched(vectors(spark, [])).count() == 0
    assert posting_lists.searched(vectors(spark, [(20, [1.0], 0)])).count() == 0
    two = spark.createDataFrame([(20, [1e200, 2e200]), (21, [1e200, 1e200])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in posting_lists.searched(two).collect()] == [21]


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].to_numpy()
    got = neighbours(entry_module.queries()["op13_posting_lists"](spark, sf).collect())
    rates = []
    for q, found in got.items():
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        rates.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & {f[1] for f in found}) / 20)
    assert len(got) == (ids % 20 == 0).sum() and np.mean(rates) >= 0.9

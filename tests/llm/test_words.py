"""Quality rules, decontamination, chunks and near-duplicates."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from decision_lens.llm import chunk_dedup, decontaminate, graph, pieces, rules, superminhash
from oracle import compare, connect
from support import LONG, documents, odd, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_decontamination", "op6_chat_windows", "op8_warc_revisits", "op9_suffix_dedup", "op10_superminhash_groups"])
def test_matches_sql(spark, name):
    assert name in entry_module.oracle_sql()
    problem, _, _ = compare(spark, connect(SF), name, SF)
    assert problem is None


def test_rules_on_odd_rows(spark):
    out = rules.judged(odd(spark)).collect()
    assert len(out) == 13
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[7]["n_words"] == 20_000 and by[5]["kept"] is True and by[5]["n_words"] == 80
    assert by[8]["n_repeat_words"] == 60 and by[8]["n_dup_lines"] == 29
    assert rules.judged(documents(spark, [])).count() == 0
    passed = rules.passing(odd(spark))
    assert passed.columns == odd(spark).columns
    left = passed.collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(r["doc_id"]) for r in out if r["kept"]) and {r["kept"] for r in left} == {"mine"}


def test_rules_take_wide_limits_for_noisy_sources(spark):
    clean = [(i, words(i, 60)) for i in range(0, 360, 6)]
    noisy = [(i, " ".join(w + "#" for w in words(i, 60).split())) for i in range(1, 361, 6)]  # another language and source
    odd_one = [(1200, noisy[0][1])]
    kept = {r["doc_id"] for r in rules.judged(documents(spark, clean + noisy + odd_one)).where("kept").collect()}
    assert {i for i, _ in clean + noisy} <= kept and 1200 not in kept


def spans_of(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = split(text), set(), set()
    for item, body in items:
        b = split(body)
        size = min(n, len(b))
        for i in range(len(b) - size + 1 if b else 0):
            for j in range(len(w) - size + 1):
                if w[j:j + size] == b[i:i + size]:
                    hit |= set(range(j, j + size))
                    ids.add(item)
    return len(w), len(hit), sorted(x for x in ids if x is not None)


ITEMS = [("a", words(1, 30)), ("b", "Only-three words"), ("c", None), ("d", ""), (None, words(2, 12)), ("a", words(3, 14)), ("e", "  ... ")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_decontamination_against_brute_force(spark, block_bytes):
    rows = [(1, words(7, 20) + "; " + words(1, 30).upper() + " tail"), (2, "x only three. WORDS y"), (3, words(1, 9)), (4, words(2, 12)), (5, None),
            (6, ""), (7, " ".join(words(1, 30).split()[4:17]) + " " + words(3, 14)), (8, LONG + " " + words(1, 30)), (8, "again"), (None, words(1, 30))]
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    out = decontaminate.scanned(documents(spark, rows), items, block_bytes=block_bytes).collect()
    got = sorted((r["n_words"], r["n_hit"], tuple(r["items"])) for r in out)
    assert got == sorted((a, b, tuple(c)) for a, b, c in (spans_of(t, ITEMS) for _, t in rows))


def test_window_set_is_small_and_exact():
    import pickle
    import tracemalloc
    r = random.Random(4)
    vocabulary = [words(i, 1) for i in range(3000)]
    items = [(f"i{k}", " ".join(r.choices(vocabulary, k=r.choice([3, 40, 400])))) for k in range(3000)]
    items += [("again", "la " * 500), (None, items[0][1]), ("i0", items[0][1]), ("other", items[1][1]), ("none", " ;"), ("null", None)]
    size = sum(len(t or "") for _, t in items)
    tracemalloc.start()
    made = decontaminate.WindowSet(iter(items), 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    fixed = len(made.windows) << decontaminate.BITS
    assert size > 2_000_000 and len(pickle.dumps(made)) - fixed < 6 * size and peak - fixed < 25 * size + (60 << 20)
    texts = [items[0][1].upper() + " x", "la " * 12, "la " * 9, items[1][1], "clean text"]
    assert made.scan([t.encode() for t in texts])[4] == [sorted(c for c in spans_of(t, items)[2]) for t in texts]


def test_decontamination_removes(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = documents(spark, [(1, "start here " + words(1, 30) + " and end"), (2, words(50, 40))])
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [2]
    cut = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}
    assert cut[1]["text"] == "start here and end" and cut[1]["n_chars"] == 18 and cut[2]["text"] == words(50, 40)
    with_items = odd(spark).withColumn("items", F.lit("mine"))
    assert {(r["items"], r["n_words"]) for r in decontaminate.decontaminate(with_items, items.limit(0)).collect()} == {("mine", "mine")}
    assert decontaminate.decontaminate(odd(spark), items.limit(0)).count() == 13
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_chunks_cover_and_resist_shifts():
    a, b = words(1, 400).encode(), words(2, 400).encode()
    data, bounds = chunk_dedup.chunks([a, b"", None, b"new words in front " + a, b, b"a" * 20_000])
    raw = data.tobytes()
    pieces = [[raw[x:y] for x, y in zip(c[:-1], c[1:])] for c in bounds]
    assert [b"".join(p) for p in pieces] == [a, b"", b"", b"new words in front " + a, b, b"a" * 20_000]
    assert len(set(pieces[0]) & set(pieces[3])) >= len(pieces[0]) - 3
    assert max(map(len, pieces[5])) <= chunk_dedup.MAX_CHUNK
    assert chunk_dedup.digests([a])[0][0] == chunk_dedup.digests([b, a])[0][1]


def test_passages_go_and_clean_texts_stay(spark):
    shared = words(500, 60)
    rows = [(i, words(i, 100) + ". " + shared + " " + words(1000 + i, 100)) for i in range(1, 8)] + [(20 + i, words(3000 + i, 150)) for i in range(8)]
    out = {r["doc_id"]: r for r in chunk_dedup.deduplicated(documents(spark, rows)).collect()}
    assert out[1]["text"] == rows[0][1]
    for i, t in rows[1:7]:
        spans = out[i]["removed_spans"]
        assert shared not in out[i]["text"] and len(spans) == 2
        at = t.index(shared)
        assert at - 1 <= spans[0] and spans[1] <= at + len(shared) + 2 and spans[1] - spans[0] > len(shared) / 2
        assert out[i]["n_chars"] == len(out[i]["text"])
    assert all(out[i]["text"] == t for i, t in rows[7:])


def test_passages_of_51_words_are_caught():
    r = random.Random(6)
    for lo, hi in ((1, 3), (2, 5), (3, 8)):
        some = lambda n, lo=lo, hi=hi: " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(lo, hi))) for _ in range(n))
        passages = [some(51) for _ in range(1500)]
        first, later = ([f"{some(60)} {p} {some(60)}".encode() for p in passages] for _ in range(2))
        spans = chunk_dedup.removed(later, chunk_dedup.digests(first)[0], chunk_dedup.MIN_WORDS)[2]
        assert all(spans), (lo, hi, sum(not s for s in spans))
        left = [len(p) - sum(y - x for x, y in zip(s[0::2], s[1::2])) for p, s in zip(passages, spans)]
        assert max(left) <= 100 and sum(left) / len(left) < 32


def test_passages_without_blanks_and_whole_texts(spark):
    r = random.Random(7)
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))
    long, short = han(90), han(20)
    texts = [han(80) + long + han(80), han(80) + long + han(80), han(80) + short + han(80), han(80) + short + han(80), "see you", "see you", "you see"]
    out = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicated(documents(spark, list(enumerate(texts)))).collect()}
    assert [out[i] == t for i, t in enumerate(texts)] == [True, False, True, True, True, False, True]
    assert long[25:65] not in out[1] and texts[1][:75] in out[1] and out[5] == ""


def test_digests_travel_once_and_a_common_one_is_asked_once_a_slice(spark):
    shared = words(500, 60)
    rows = [(i, words(i, 60) + ". " + shared) for i in (5, 3, 9, 4)]
    asked, known = chunk_dedup.asked_and_known([t.encode() for _, t in rows], [i for i, _ in rows])
    both = [set(x) & set(chunk_dedup.digests([shared.encode()])[0][0]) for x in asked]
    assert both[1] and not (both[0] or both[2] or both[3]) and known[1] == [] and all(known[i] for i in (0, 2, 3))
    out = chunk_dedup.deduplicated(documents(spark, rows).repartition(3)).select("doc_id", "text")
    assert {r["doc_id"]: shared[30:-30] in r["text"] for r in out.collect()} == {3: True, 4: False, 5: False, 9: False}
    # once to cut and once to remove: no second reading and sending of the digests
    plan = chunk_dedup.deduplicated(documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Window" in plan
    # ids that Python may order in another way are left to Spark
    named = chunk_dedup.deduplicated(documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("decimal(9,1)"))).select("doc_id", "text")
    assert {int(r["doc_id"]): shared[30:-30] in r["text"] for r in named.collect()} == {3: True, 4: False, 5: False, 9: False}


def test_chunks_on_odd_rows(spark):
    out = chunk_dedup.without_repeats(odd(spark).withColumn("n_chunks", F.lit("mine")))
    assert {r["n_chunks"] for r in out.collect()} == {"mine"}
    out = out.drop("n_chunks")
    assert out.columns == odd(spark).columns
    rows = defaultdict(list)
    for r in out.collect():
        rows[r["doc_id"]].append(r["text"])
    assert rows[1] == [None] and rows[2] == [""] and rows[7] == [LONG] and rows[5] == [words(5, 80)] and rows[6][0] == rows[6][1]
    assert len(rows[6][0]) < 120 and words(5, 80) in rows[None] and rows[8] == ["ß▁é 😀\r\n" * 30]
    assert chunk_dedup.deduplicated(documents(spark, [])).count() == 0


def classes(rows, n, percent=80):
    """Component of each id by brute force."""
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        s = {tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
        sets[i].append(s)
    ids = list(sets)
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = root(x), root(y)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_rows():
    r, rows = random.Random(4), []
    for g in range(12):
        base = words(g, 120).split()
        for k in range(12):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = words(r.randrange(10**6), 1)
            rows.append((g * 40 + k, " ".join(w)))
    return rows + [(900, "one two three"), (901, "ONE two\nthree"), (902, "one two"), (903, None), (904, "")]


@pytest.mark.parametrize("n", [4, 5])
def test_groups_against_brute_force(spark, n):
    rows = near_rows()
    want = classes(rows, n)
    got = {r["doc_id"]: r for r in superminhash.groups(documents(spark, rows), shingle=n).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_groups_on_odd_rows(spark):
    out = superminhash.groups(odd(spark)).collect()
    assert len(out) == 13
    by = {r["doc_id"]: r for r in out}
    assert by[None]["component_id"] is None and by[None]["kept"] and by[6]["component_id"] == 5 and not by[6]["kept"]
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[4]["n_shingles"] == 1 and by[7]["component_id"] == 7
    left = superminhash.distinct_documents(odd(spark))
    assert left.columns == odd(spark).columns and sorted(Counter(r["doc_id"] for r in left.collect()).items(), key=str) == sorted(
        Counter(i for i in [1, 2, 3, 4, 5, 7, 8, 9, 10, None, None]).items(), key=str)
    assert superminhash.groups(documents(spark, [])).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    a, b = words(1, 100), words(2, 100)
    got = {(r["doc_id"], r["component_id"]) for r in superminhash.groups(documents(spark, [(1, a), (5, a), (5, b), (9, b)])).collect()}
    assert got == {(1, 1), (5, 1), (9, 1)}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    common = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    x, y = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
    sig = superminhash.signatures([x, y, x[:1], x[:0]])
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.15
    assert len(set((sig[2] >> np.uint64(32)).tolist())) == superminhash.SLOTS  # one element: a slot a round
    assert (sig[3] == superminhash.EMPTY).all() and (superminhash.signatures([x])[0] == sig[0]).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)] + [(500, 500), (None, 3)]
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    top = {}
    for u, v in edges[:-2]:
        top.setdefault(u, {u})
        top.setdefault(v, {v})
        both = top[u] | top[v]
        for x in both:
            top[x] = both
    assert got == {x: min(s) for x, s in top.items() if len(s) > 1}


def test_ties_find_every_component():
    """Few pairs a turn, failed ones left out, until no candidate joins two parts: the components of all links."""
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(3)]
    sets = []
    for i in range(90):
        own = r.choice(base[i % 3], r.integers(150, len(base[i % 3]) + 1), replace=False)
        sets.append(np.unique(np.concatenate([own, r.integers(0, 1 << 63, r.integers(0, 40), dtype=np.uint64)])))
    n, size = len(sets), np.array([len(s) for s in sets])
    sketch = (superminhash.mixed(superminhash.signatures(sets)) & np.uint64(255)).astype(np.uint8)
    fine = [s.astype(np.uint16) if i % 10 else np.zeros(0, np.uint16) for i, s in enumerate(sets)]
    node = np.arange(n) * 7 + 5

    def link(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= 80 * (size[i] + size[j] - both)

    def joined(part, pairs):
        for i, j in pairs:
            part[part == max(part[i], part[j])] = min(part[i], part[j])
        return part

    want = joined(np.arange(n), [(i, j) for i in range(n) for j in range(i) if link(i, j)])
    part, failed, turns, tried, most = np.arange(n), [[] for _ in range(n)], 0, set(), 1
    while True:
        a, b = superminhash.tied(node, part.copy(), size, sketch, np.zeros(n, dtype=int), fine, [np.array(f, dtype=np.int64) for f in failed], 80, most)
        pairs = [(int(x - 5) // 7, int(y - 5) // 7) for x, y in zip(a, b)]
        assert not tried & set(pairs) and (most > 1 or len(pairs) < n)
        if not pairs:
            break
        tried |= set(pairs)
        for i, j in pairs:
            if not link(i, j):
                failed[max(i, j)].append(node[min(i, j)])
        part, turns, most = joined(part, [p for p in pairs if link(*p)]), turns + 1, most * 2
    assert (part == want).all() and 1 < turns + 1 < 12

def test_results_keep_columns_with_inner_names(spark):
    df = odd(spark)
    for out in (rules.judged(df), chunk_dedup.deduplicated(df), superminhash.distinct_documents(df), decontaminate.scanned(df, spark.createDataFrame(ITEMS, "item_id string, text string")),
                pieces.encoded(df)):
        for name in ("id_", "repeats_", "rest_", "gone_id_", "row_key_", "wh_", "word_hashes_", "lang_", "source_", "s_", "p_", "capitals_", "row_"):
            assert {r[0] for r in out.select(name).distinct().collect()} == {"mine"}, name

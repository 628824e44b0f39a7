"""Classifier, pieces, chat windows, language model, archives, repeated strings, pipeline."""

import gzip
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry_module
import corpus_pipeline
from decision_lens.llm import attention_lm, chat, pieces, quality_cnn, suffix_dedup, textkit, warc
from decision_lens.llm.blocks import packed
from support import LONG, documents, odd, words
from test_words import classes, spans_of

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_rows(spark):
    rows = entry_module.queries()["op1_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good, bad = ([r["score"] for r in out if r["quality"] == y] for y in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_classifier_gradients():
    net = quality_cnn.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y = [b"some bytes here and more of them", b"", b"xy" * 40], np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(net.score(texts)) + (1 - y) * np.log(1 - net.score(texts)))
    for name, g in net.gradients(texts, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-5
        up = loss()
        net.p[name][at] = keep - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])), name
        net.p[name][at] = keep


def test_classifier_on_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(5, 0), (None, 1), (3, None)], "doc_id long, quality long")
    out = quality_cnn.scored(odd(spark), labels).collect()
    assert len(out) == 13 and all(0 <= r["score"] <= 1 for r in out) and len({round(r["score"], 6) for r in out if r["doc_id"] == 6}) == 1
    assert {r["score"] for r in quality_cnn.scored(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality_cnn.scored(odd(spark), labels.where("quality = 1")).collect()} == {1.0}
    assert quality_cnn.scored(documents(spark, []), labels).count() == 0


def test_pieces_round_trip_and_repeat(spark):
    docs = odd(spark).withColumn("text_again", F.col("text"))
    ids = pieces.encoded(docs, seed=1)
    rows = pieces.decoded(ids).collect()
    assert len(rows) == 13 and all(r["decoded"] == r["text"] for r in rows)
    first = {(r["doc_id"], r["text"]): r["ids"] for r in rows}
    again = {(r["doc_id"], r["text"]): r["ids"] for r in pieces.encoded(docs.repartition(3), seed=1).collect()}
    other = {(r["doc_id"], r["text"]): r["ids"] for r in pieces.encoded(docs, seed=2).collect()}
    assert first == again and first[7, LONG] != other[7, LONG] and first[5, words(5, 80)] != first[6, words(5, 80)]
    assert first[2, ""] == [] and first[1, None] is None
    assert pieces.encoded(documents(spark, [])).count() == 0


def test_ids_and_what_they_spell_come_from_one_worker(spark):
    docs = odd(spark)
    both = pieces.encoded(docs, decoded="decoded")
    assert sorted(map(str, both.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, pieces.decoded(pieces.encoded(docs)).select("doc_id", "ids", "decoded").collect()))
    out = corpus_pipeline.piece_ids(spark, docs.drop("ids"), "")
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in docs.collect())
    for df in (corpus_pipeline.piece_ids(spark, docs.drop("ids"), ""), entry_module.queries()["op3_sampled_pieces"](spark, SF)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_samples_follow_the_lattice():
    v = pieces.Vocabulary(pieces.model_path())
    text = "the"
    known = {p.replace(pieces.MARK, " "): i for i, p in enumerate(v.pieces)}
    ways = {}

    def walk(rest, ids, weight):
        if not rest:
            ways[tuple(ids)] = weight
        for k in range(1, len(rest) + 1):
            if rest[:k] in known:
                walk(rest[k:], [*ids, known[rest[:k]]], weight * v.weight[known[rest[:k]]])

    walk(" " + text, [], 1.0)
    n = 40_000
    drawn = v.encode([text] * n, np.arange(n, dtype=np.uint64))
    seen = {}
    for d in drawn:
        seen[tuple(d.tolist())] = seen.get(tuple(d.tolist()), 0) + 1
    total = sum(ways.values())
    assert set(seen) <= set(ways)
    for ids, weight in ways.items():
        p = weight / total
        assert abs(seen.get(ids, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def rows_of_chat():
    r = random.Random(2)
    rows = [(1, 0, "system", "be < good \\l"), (1, 1, "user", None), (1, 2, "assistant", "</turn><turn>user<text>"), (1, 2, "assistant", "\\b\\l<"),
            (2, 5, "user", ""), (2, None, None, "first"), (2, 6, "assistant", "x" * 9000), (None, 1, "assistant", "no id"), (2, 6, "assistant", "x" * 9000)]
    rows += [(4, i, "system" if i < 2 else "user", words(i, 5000 if i in (3, 40) else 300)) for i in range(50)]
    rows += [(5, i, "system" if i == 0 else "assistant", words(i, 600 if i == 0 else 1021 if i % 5 else 3)) for i in range(30)]
    return rows + [(3, i, ["system", "user", "assistant"][0 if i == 0 else 1 + i % 2], words(i, r.randint(0, 200))) for i in range(700)]


def test_chat_reads_back(spark):
    rows = rows_of_chat()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(4)
    w = chat.windows(chat.turns_of(df)).cache()
    got = {r["conv_id"]: r for r in chat.digests(w).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        taught = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(taught), hashlib.sha256(taught.encode()).hexdigest())
    long = w.where("conv_id = 3").orderBy("window").collect()
    assert len(long) > 20 and all(r["formatted"].startswith("<turn>system<text>") for r in long) and all(r["n_repeat"] >= 2 for r in long[1:])
    # the system turn and the repeats are counted; only a single turn that is longer than the room may exceed the budget
    for r in w.collect():
        turns = r["formatted"].split("</turn>")[:-1]
        assert r["n_tokens"] == sum(len(x.partition("<text>")[2].split()) + chat.MARKS for x in turns)
        assert r["n_tokens"] <= chat.BUDGET or len(turns) == 1 + r["n_repeat"]
    assert sum(r["formatted_chars"] for r in got.values()) == w.agg(F.sum(F.length("formatted"))).first()[0]
    assert chat.digests(chat.windows(chat.turns_of(df.limit(0)))).count() == 0


def test_chat_query_has_the_escaped_conversation(spark):
    row = entry_module.queries()["op6_chat_windows"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def small_model(seed=1):
    r = np.random.default_rng(seed)
    return attention_lm.Model(r.integers(0, 50, attention_lm.N_IDS), attention_lm.beginning(attention_lm.vocabulary_path()), seed)


def test_network_probabilities_add_up():
    m = small_model()
    r = np.random.default_rng(0)
    for k in m.p:
        m.p[k] = m.p[k] + r.normal(0, 0.3, m.p[k].shape).astype(np.float32)
    size = attention_lm.CONTEXT + attention_lm.STRIDE
    x = np.tile(r.integers(0, attention_lm.SLOTS, size).astype(np.int16), (attention_lm.SLOTS, 1))
    targets = np.tile(np.arange(attention_lm.SLOTS)[:, None], (1, attention_lm.STRIDE))
    lp, begin = (v.reshape(attention_lm.SLOTS, -1) for v in m.log_probability(x, targets))
    assert np.allclose(np.exp(lp).sum(axis=0), 1, atol=1e-3)
    assert np.allclose(np.exp(lp[:attention_lm.BEGIN]).sum(axis=0), np.exp(begin[0]), atol=1e-3)
    for tail in (attention_lm.TAIL_BEGIN, attention_lm.TAIL_ON):
        assert abs(np.exp(m.tail_log[m.slot == tail]).sum() - 1) < 1e-6
    # what follows a place doesn't change it
    y = x.copy()
    y[:, attention_lm.CONTEXT + 5:] = 3
    again = m.log_probability(y, targets)[0].reshape(attention_lm.SLOTS, -1)
    assert np.allclose(lp[:, :5], again[:, :5], atol=1e-4)


def test_network_gradients():
    m = small_model()
    m.p = {k: v.astype(np.float64) + np.random.default_rng(3).normal(0, 0.2, v.shape) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    x = r.integers(0, attention_lm.SLOTS + 2, (3, attention_lm.CONTEXT + attention_lm.STRIDE))
    x[0, :4] = attention_lm.PAD
    t = r.integers(0, attention_lm.SLOTS, (3, attention_lm.STRIDE))
    known = (r.random(t.shape) < 0.8).astype(np.float64)
    loss = lambda: -(m.log_probability(x, t)[0] * known.ravel()).sum() / known.sum()
    for name, g in m.gradients(x, t, known).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = m.p[name][at]
        m.p[name][at] = keep + 1e-3
        up = loss()
        m.p[name][at] = keep - 1e-3
        assert abs((up - loss()) / 2e-3 - g[at]) < 0.02 * abs(g[at]) + 1e-3, name
        m.p[name][at] = keep


def test_windows_score_every_id_once():
    m = small_model()
    texts = [b"", b"one", words(1, 7).encode(), words(2, 90).encode()]
    b = attention_lm.Block(packed([1, 2, 3, 4], texts), 10)
    flat, bounds = b.stream(*attention_lm.subwords(b.words(), attention_lm.vocabulary_path()))
    assert b.n_words.tolist() == [0, 1, 7, 90] and (flat[bounds[1:] - 1] == attention_lm.END).all()
    lp, begin = m.positions(flat, bounds)
    assert (lp < 0).all() and (begin < 0).all()
    alone = [m.positions(*attention_lm.Block(packed([9], [t]), 10).stream(*attention_lm.subwords(attention_lm.Block(packed([9], [t]), 10).words(), attention_lm.vocabulary_path())))[0] for t in texts]
    assert np.allclose(np.concatenate(alone), lp, atol=1e-4)


def test_scores_on_odd_rows(spark):
    import math
    import re
    from collections import Counter
    df = odd(spark)
    rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())) for r in df.collect()]
    c = Counter()
    for i, w in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update([*w, "\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, len(w) + 1, sum(c[x] > 0 for x in [*w, "\n"]), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, "\n"]), 3)) for i, w in rows)
    out = attention_lm.scored(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert attention_lm.scored(documents(spark, [])).count() == 0


def test_training_windows_grow_with_the_corpus():
    """A fixed share of the windows of every training text, not a number a block or in all."""
    def picked(n, share):
        b = attention_lm.Block(packed(list(range(1, n + 1)), [words(i, 300).encode() for i in range(n)]), 10)
        ids, at = attention_lm.subwords(b.words(), attention_lm.vocabulary_path())
        flat, bounds = b.stream(ids, at, np.flatnonzero(~b.held_out))
        order, seen = attention_lm.training_windows(b, ids, at, share)
        return len(order), len(attention_lm.window_index(bounds)[0]), seen[:, attention_lm.CONTEXT + 1:], flat

    n, all_, targets, flat = picked(40, 1.0)
    assert n == all_ > 500 and np.array_equal(targets[targets < attention_lm.N_IDS], flat)
    few, more = picked(40, 0.25), picked(160, 0.25)
    assert abs(few[0] / few[1] - 0.25) < 0.06 and abs(more[0] / more[1] - 0.25) < 0.03 and more[0] > 3 * few[0]
    assert attention_lm.HIDDEN == 32


def test_every_training_window_is_learned_from_once_on_every_size():
    """No share and no number of passes that follow the size of the table or the number of shards."""
    for n in (12, 400):
        blob = packed(list(range(1, n + 1)), [words(i, 300).encode() for i in range(n)])
        b = attention_lm.Block(blob, 10)
        flat, bounds = b.stream(*attention_lm.subwords(b.words(), attention_lm.vocabulary_path()), np.flatnonzero(~b.held_out))
        (sent,) = [r for r in attention_lm.first_pass(blob, 4, 10, attention_lm.vocabulary_path()) if r[0] == "window"]
        assert sent[2] == len(attention_lm.window_index(bounds)[0])
        for shards in (1, 3):
            m, seen = small_model(), []
            m.gradients = lambda x, t, known: seen.append(int(known.sum())) or {}
            state, dealt = m.start(), list(attention_lm.dealt_windows(sent[3], shards))
            for turn in range(attention_lm.ROUNDS):
                for shard, part in dealt:
                    w = np.frombuffer(zlib.decompress(part), dtype=attention_lm.WINDOW)
                    m.train(state, w["ids"], turn, attention_lm.ROUNDS, seed=shard)
            assert len(dealt) == shards and sum(seen) == len(flat)


def test_spellings_are_staged_and_sent_packed():
    blob, path = packed([1, 2], [words(i, 3000).encode() for i in (1, 2)]), attention_lm.vocabulary_path()
    (sent,) = [r for r in attention_lm.first_pass(blob, 4, 10, path) if r[0] == "subwords"]
    b = attention_lm.Block(blob, 10)
    ids, at = attention_lm.subwords(b.words(), path)
    raw = zlib.decompress(sent[3])
    n = len(b.hash)
    assert len(sent[3]) < 0.7 * len(raw)
    assert np.array_equal(np.frombuffer(raw, dtype=np.int32, count=n), np.diff(at)) and np.array_equal(np.frombuffer(raw, dtype=np.uint16, offset=4 * n), ids)


def test_spelled_blocks_keep_words_and_windows():
    path = attention_lm.vocabulary_path()
    texts = [b"", b"one", words(1, 900).encode(), ("Ab" * 700 + " \u00df\u4e16\u754c it's").encode(), b"next", words(1, 50).encode()]
    for blob in (packed([1, None, 2, 3, 2, 10**12], texts), packed([5], [b""])):
        b = attention_lm.Block(blob, 10)
        ids, at = attention_lm.subwords(b.words(), path)
        data, n_windows, _ = attention_lm.spelled_block(blob, 10, path)
        back = attention_lm.Spelled(data, 10, path)
        for name in ("ids", "n_words", "word", "hash", "trained", "held_out", "doc"):
            assert np.array_equal(getattr(b, name), getattr(back, name)), name
        assert np.array_equal(ids, back.sub) and np.array_equal(at, back.at)
        order, seen = attention_lm.training_windows(back, back.sub, back.at)
        assert n_windows == len(order) == len(attention_lm.training_windows(b, ids, at)[0])
        slots = small_model().slots(seen)
        assert np.array_equal(attention_lm.unpacked_slots(attention_lm.packed_slots(slots), len(slots)), slots)
        rows = list(attention_lm.word_rows(back, 4))
        assert np.array_equal(np.concatenate([np.zeros(0, dtype=np.uint64), *[attention_lm.hashes_of(r[1]) for r in rows]]), b.hash)


def test_a_chunk_spells_a_word_once(monkeypatch):
    """Blocks of a chunk are spelled as if alone, but a word of several is spelled and sent once."""
    path = attention_lm.vocabulary_path()
    common = words(1, 900)
    blobs = [packed([i, None], [(common + " " + words(i, 40)).encode(), b"it's"]) for i in range(1, 6)] + [packed([9], [b""])]
    alone, spelled, subwords = [attention_lm.spelled_block(blob, 10, path) for blob in blobs], [], attention_lm.subwords
    monkeypatch.setattr(attention_lm, "subwords", lambda own, path: spelled.extend(own) or subwords(own, path))
    data, n_windows, counts = attention_lm.spelled_chunk(blobs, 10, path)
    assert data == [x[0] for x in alone] and n_windows == sum(x[1] for x in alone)
    assert len(spelled) == len(set(spelled)) < 0.3 * sum(len(attention_lm.Block(blob, 10).hash) for blob in blobs)
    blocks = [attention_lm.Spelled(x, 10, path) for x in data]
    both = attention_lm.Words(blocks)
    assert len(both.hash) == len(spelled) and all(np.array_equal(both.hash[w], b.hash) for w, b in zip(both.of_block, blocks))
    assert both.trained.sum() == sum(b.trained.sum() for b in blocks)
    sent = list(attention_lm.word_rows(both, 3))
    assert len(sent) <= 8 and np.array_equal(np.concatenate([attention_lm.hashes_of(r[1]) for r in sent]), both.hash)


def test_lots_of_shards_hold_what_shards_hold(spark, monkeypatch):
    """Messages go to lots, whose number does not follow the number of shards alone; shards are the same."""
    path, made = attention_lm.vocabulary_path(), attention_lm.pa.schema([("data", attention_lm.pa.list_(attention_lm.pa.binary())), ("n_windows", attention_lm.pa.int64()),
                                                                        ("id_counts", attention_lm.pa.binary())])
    docs = documents(spark, [(i, words(i, 300)) for i in range(300)]).repartition(3)
    blocks = attention_lm.blocks_of(docs, "doc_id", "text", lambda blobs: attention_lm.spelled_chunk(blobs, 10, path), made, "data array<binary>, n_windows long, id_counts binary")
    m, found = small_model(), []
    for lots in (1000, 2):
        monkeypatch.setattr(attention_lm, "LOTS", lots)
        shards = attention_lm.shards_of(m, blocks, 400, 10, path).collect()
        found.append({r["shard"]: attention_lm.unpacked_slots(r["slots"], r["n"]) for r in shards})
        assert len(shards) == len(found[-1]) > 20
    assert all(np.array_equal(found[0][k], found[1][k]) for k in found[0]) and found[0].keys() == found[1].keys()
    order = np.array([3, 1, 3, 2, 1, 3], dtype=np.uint32)
    slots = np.array([[5, 1], [9, 9], [5, 0], [7, 7], [8, 9], [4, 9]], dtype=np.int16)
    assert attention_lm.sorted_windows(order, slots).tolist() == [4, 1, 3, 5, 2, 0]


def test_windows_are_staged_once(spark):
    from pathlib import Path

    from decision_lens.session import scratch_dir
    staged = lambda: sum(f.stat().st_size for f in Path(scratch_dir(spark).removeprefix("file:"), "staged").rglob("*.parquet"))
    texts = [(i, words(i, 300)) for i in range(4000)]
    df = documents(spark, texts).repartition(2)
    before = staged()
    attention_lm.scored(df, shard_windows=16384)
    assert 0 < staged() - before < 2.5 * sum(len(t) for _, t in texts)


def test_averaged_shards_learn_and_do_not_follow_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 16 = 0")
    a, b = (attention_lm.scored(docs.repartition(n), shard_windows=128).orderBy("doc_id").collect() for n in (2, 5))
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b], rtol=1e-3)


def test_context_keeps_its_weight_on_large_corpora():
    c = np.array([100_000])
    for words_ in (10**6, 10**9, 10**12):
        counts = attention_lm.Counts(words_, 10**5, 10**4, 10**3, 10**4)
        likely, unlikely = (counts.mixed(c, np.array([x]))[0] for x in (-1.0, -12.0))
        assert likely - unlikely > 0.5 and likely < 0
    counts = attention_lm.Counts(90, 4, 1, 1, 10)
    known = np.array([60, 27, 2, 1, 10])  # with the ends of texts
    spelled = np.array([0.3, 0.2, 0.1, 0.1, 0.1])  # the network leaves 0.2 to unknown words
    total = np.exp(counts.mixed(known, np.log(spelled))).sum() + np.exp(counts.mixed(np.array([0]), np.log([0.2]))).sum()
    assert abs(total - 1) < 1e-9


def test_shuffled_known_words_score_less(spark):
    ring = "the house and a dog of our time is in that long year with some more people".split()
    text = lambda i: " ".join(ring[(i + j) % len(ring)] for j in range(120))
    rows = [(i, text(i)) for i in range(1, 400)]
    r = random.Random(4)
    for i in range(40):
        mixed_up = text(i).split()
        r.shuffle(mixed_up)
        rows += [(None, text(i)), (None, " ".join(mixed_up))]
    out = attention_lm.scored(documents(spark, rows)).where("doc_id IS NULL").orderBy("score").collect()
    # few words among many: counts say the same of both, and V / N is below 0.001
    assert len({round(x["base_score"], 6) for x in out}) < 20 and all(x["n_known"] == 121 for x in out)
    a, b = (sum(x["score"] for x in part) / 40 / 121 for part in (out[40:], out[:40]))
    assert a - b > 0.2


def test_training_helps(spark):
    rows = entry_module.queries()["op7_attention_scores"](spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert rows[0] / rows[1] > -6.5


def test_archives_round_trip(spark, tmp_path):
    body = "payload with\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc é"
    pages = spark.createDataFrame([(1, "http://a/", body, 1), (2, None, None, 1), (3, "http://c/\r\nX: y", "", 2), (4, "http://d/", body, 3), (4, "http://d/", body, 3),
                                   (5, "http://e/", "z" * 300_000, 0)], "page_id long, url string, html string, record_type long").repartition(3)
    warc.write_archives(pages, f"{tmp_path}/a", rows_a_file=1)
    records = warc.read_archives(spark, f"{tmp_path}/a")
    assert {(r["page_key"], bytes(r["payload"]).decode()) for r in records.where("record_type = 'response'").collect()} == {
        ("4", body), ("3", ""), ("5", "z" * 300_000)}
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.with_originals(records).collect())
    size = len(body.encode())
    assert got == [(1, size, "revisit", 4), (2, 0, "revisit", 3), (3, 0, "response", None), (4, size, "response", None), (4, size, "response", None), (5, 300_000, "response", None)]
    assert all(r["payload_digest"] == r["computed_digest"] for r in records.where("record_type = 'response'").collect())
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.with_originals(warc.read_archives(spark, f"{tmp_path}/none")).count() == 0
    plain = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    for name, data in (("two.warc.gz", gzip.compress(plain) + gzip.compress(plain)), ("plain.warc", plain)):
        (tmp_path / "others").mkdir(exist_ok=True)
        (tmp_path / "others" / name).write_bytes(data)
    assert [bytes(r["payload"]) for r in warc.read_archives(spark, f"{tmp_path}/others").collect()] == [b""] * 3
    for step in (1, 7, len(plain)):
        pieces = [(plain * 2)[i:i + step] for i in range(0, 2 * len(plain), step)]
        assert [block for _, block in warc.parsed(pieces)] == [b"ok", b"ok"]
    for bad in (plain + b"junk\r\n\r\n", plain[:-1], plain + b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            list(warc.parsed([bad]))


def test_payloads_are_not_shuffled_by_digest(spark):
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id") % 3).alias("html"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(warc.resolved(warc.pages_of(pages))._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = [node for node in plan.split("\n\n") if "Arguments: hashpartitioning(sha" in node]
    assert moved and not any("body" in node for node in moved)


def test_plain_archives_and_dates(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/p", compression="none", date="2024-01-01T00:00:00Z")
    assert sorted((r["page_id"], r["record_type"]) for r in warc.with_originals(warc.read_archives(spark, f"{tmp_path}/p")).collect()) == [(1, "revisit"), (2, "response")]
    assert "WARC-Date: 2024-01-01T00:00:00Z" in "".join(r["value"] for r in spark.read.text(f"{tmp_path}/p").collect())


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/b", min_bytes=5)
    assert {r["record_type"] for r in warc.read_archives(spark, f"{tmp_path}/b").collect()} == {"response"}


def cut_by_hand(rows):
    """(id, n_bytes, n_removed, n_spans, kept digest), in any order."""
    known, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - 49):
                known[b[p:p + 50]] = min(i, known.get(b[p:p + 50], i))
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if i is not None and known[b[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        spans = sum(g and (q == 0 or not gone[q - 1]) for q, g in enumerate(gone))
        out.append((i or -1, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def repeated_rows():
    r = random.Random(8)
    parts = [words(i, 12)[:r.randint(49, 80)] for i in range(12)] + ["ab" * 40, "a" * 70]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.6 else words(r.randrange(10**6), r.randint(1, 15)) for _ in range(r.randint(0, 9)))) for i in range(60)]
    return rows + [(70, rows[3][1]), (70, rows[3][1]), (None, rows[4][1]), (71, None), (-4, rows[9][1] + "ß" * 40), (72, "ß" * 40)]


def test_repeated_strings_against_brute_force(spark):
    rows = repeated_rows()
    out = suffix_dedup.deduplicated(documents(spark, rows).repartition(3), with_kept=True).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == cut_by_hand(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


def test_hot_anchors_against_brute_force(spark):
    r = random.Random(11)
    phrase = words(7, 30)[:40]
    rows = repeated_rows() + [(100 + i, words(i, 6) + phrase + words(r.randrange(9), 12)) for i in range(80)]
    for hot in (0, 20):
        out = suffix_dedup.deduplicated(documents(spark, rows).repartition(5), hot=hot).collect()
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == cut_by_hand(rows)


def test_a_hot_anchor_spreads_over_buckets():
    """Documents that share 40 bytes between different neighbours must not meet in one bucket."""
    phrase, bits, sent = words(7, 30)[:40].encode(), 6, {}
    blocks = [packed(list(range(i * 500, i * 500 + 500)), [words(j + 10**6, 20).encode() + phrase + words(j, 20).encode() for j in range(i * 500, i * 500 + 500)])
              for i in range(48)]
    for n, blob in enumerate(blocks):
        for bucket, a, b in suffix_dedup.anchor_hashes(blob, bits):
            sent.setdefault(bucket, []).append((0, n, a, b))
    answers, got = {}, {}
    for bucket, rows in sent.items():
        for _, n, answer in suffix_dedup.shared_hashes(rows):
            answers.setdefault(n, []).append((bucket, answer))
    for n, blob in enumerate(blocks):
        for bucket, data in suffix_dedup.surroundings(blob, answers[n], bits):
            got[bucket] = got.get(bucket, 0) + len(data)
    assert len(got) > 40 and max(got.values()) < 0.1 * sum(got.values())


def test_repeated_strings_on_odd_rows(spark):
    df = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = suffix_dedup.deduplicated(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == cut_by_hand(rows)
    assert suffix_dedup.deduplicated(documents(spark, [])).count() == 0


def test_suffix_sort_and_its_correction():
    r = np.random.default_rng(6)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[0:400]
    starts, segment = np.arange(2900), np.sort(r.integers(0, 4, 2900))
    order = suffix_dedup.Suffixes(data, 50).sort(starts, segment)
    for s in range(4):
        own = [data[i:i + 50].tobytes() for i in starts[order][segment == s]]
        assert own == sorted(own) and len(own) == (segment == s).sum()
    wrong = order.copy()
    wrong[[10, 11, 12]] = wrong[[12, 10, 11]]
    fixed = suffix_dedup.confirmed_order(data, starts, segment, wrong)
    assert [data[i:i + 50].tobytes() for i in starts[fixed]] == [data[i:i + 50].tobytes() for i in starts[order]]


def test_messages_follow_chunks_and_fill_buckets_alike(spark):
    """One message for a chunk and bucket, not for a block and bucket; anchors are least hashes, which must not meet in the first buckets."""
    from decision_lens.llm.blocks import blocks_of
    blobs = [packed([i], [words(i, 20_000).encode()]) for i in range(6)]
    sizes = [len(a) for _, a, _ in suffix_dedup.anchor_hashes(blobs, 5)]
    assert len(sizes) == 32 and max(sizes) < 2 * sum(sizes) / 32
    made = blocks_of(documents(spark, [(i, words(i, 100) * 500) for i in range(50)]).repartition(1), "doc_id", "text").collect()
    assert len(made) == 1 and len(made[0]["data"]) > 8


def test_chunks_give_what_their_blocks_give():
    r, rows = random.Random(5), repeated_rows()
    phrase = words(7, 30)[:40]
    rows += [(100 + i, words(i, 6) + phrase + words(r.randrange(9), 12)) for i in range(80)]
    for hot in (0, 20, suffix_dedup.HOT):
        for size in (1, 3, 100):
            blobs = [packed([i for i, _ in rows[k:k + 20]], [(t or "").encode() for _, t in rows[k:k + 20]]) for k in range(0, len(rows), 20)]
            chunks, sent, shared, around, replies = [blobs[k:k + size] for k in range(0, len(blobs), size)], {}, {}, {}, {}
            for n, chunk in enumerate(chunks):
                for bucket, a, b in suffix_dedup.anchor_hashes(chunk, 4):
                    sent.setdefault(bucket, []).append((0, n, a, b))
            for bucket, own in sent.items():
                for _, n, answer in suffix_dedup.shared_hashes(own, hot):
                    shared.setdefault(n, []).append((bucket, answer))
            for n, chunk in enumerate(chunks):
                for bucket, data in suffix_dedup.surroundings(chunk, shared.get(n, []), 4):
                    around.setdefault(bucket, []).append((0, n, data, None))
            for bucket, own in around.items():
                for _, n, answer in (suffix_dedup.string_answers if bucket >> 4 else suffix_dedup.answers)(own):
                    replies.setdefault(n, []).append(answer)
            out = [x for n, chunk in enumerate(chunks) for x in suffix_dedup.cut(chunk, replies.get(n, []))]
            assert sorted((i or -1, *x, hashlib.sha256(kept).hexdigest()) for i, *x, kept in out) == cut_by_hand(rows)


def test_long_runs_of_suffixes_are_sorted_by_words():
    r = np.random.default_rng(6)
    data = r.integers(97, 99, 6000).astype(np.uint8)
    data[1000:1400] = data[0:400]
    data[5000:] = 97
    starts, segment = np.arange(5900), np.sort(r.integers(0, 4, 5900))
    order, tied = suffix_dedup.by_words(data, starts, segment)
    assert np.diff(suffix_dedup.runs(tied)).max() <= suffix_dedup.FEW and (np.diff(segment[order]) >= 0).all()
    order = order[suffix_dedup.Suffixes(data, 50).sort(starts[order], tied)]
    for s in range(4):
        own = [data[i:i + 50].tobytes() for i in starts[order][segment == s]]
        assert own == sorted(own) and len(own) == (segment == s).sum()


def test_a_merge_compares_each_pair_of_suffixes_once():
    class Counted(suffix_dedup.Suffixes):
        compared = 0

        def common(self, a, b):
            self.compared += len(a)
            return super().common(a, b)

    r = np.random.default_rng(2)
    sort = Counted(r.integers(97, 99, 4000).astype(np.uint8), 50)
    starts = r.permutation(3900)
    order = sort.sort(starts, np.arange(3900) // 2)
    assert sort.compared == 1950 and sorted(order.tolist()) == list(range(3900))
    text = [sort.data[i:i + 50].tobytes() for i in starts[order]]
    assert all(a <= b for a, b in zip(text[::2], text[1::2]))


def test_anchors_do_not_follow_the_place_in_a_block():
    """The least hash of every string, also where the search for them is cut into steps."""
    text = words(3, 9000).encode()
    size = suffix_dedup.STEP
    assert len(text) > size + 2000
    for ahead in (0, 49, size - 1000, 2 * size - 60):
        a = suffix_dedup.Anchors(packed([1, 2, 3], [b"x" * ahead, text, b"y" * 30]))
        own = a.doc == 1
        if not ahead:
            want, hashes = a.place[own], a.hash[own]
        assert np.array_equal(a.place[own] - ahead, want) and np.array_equal(a.hash[own], hashes)
    assert np.diff(want).max() <= suffix_dedup.REACH + 1 and want[0] <= suffix_dedup.REACH


def test_pipeline_stages(spark, tmp_path):
    shared = words(500, 60)
    item = words(800, 25)
    good = [(i, words(i, 120)) for i in range(1, 30)]
    rows = good + [(40, good[0][1]), (41, good[1][1] + " extra"), (42, words(42, 80) + ". " + shared + " " + words(43, 80)), (43, words(44, 80) + ". " + shared + " " + words(45, 80)),
                   (44, words(46, 90) + " " + item), (45, "too short"), (46, None), (47, "word " * 200), (48, words(48, 120) + " | # $"[:2])]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        d = f(spark, d, str(tmp_path)).cache()
        if n < 4:
            assert d.columns == docs.columns, name
        left = {r["doc_id"]: r["text"] for r in d.collect()}
        texts = dict(rows)
        if n == 0:
            assert not {45, 46, 47} & set(left) and {i for i, _ in good} | {40, 41, 42, 43, 44} <= set(left)
        if n == 1:
            want = classes([(i, t) for i, t in rows if i not in (45, 46, 47)], 5)
            assert set(left) == {i for i in want if want[i] == i} & set(left) and not {40, 41} & set(left) and {i for i, _ in good} <= set(left)
        if n == 2:
            assert shared in left[42] and shared not in left[43] and all(left[i] == t for i, t in good)
        if n == 3:
            assert set(left) == {i for i in left if not spans_of(texts[i], [("q", item)])[1]} and 44 not in left
        if n == 4:
            assert all(left[i] == t for i, t in good)
    run = {(r["doc_id"], r["text"], tuple(r["ids"])) for r in entry_module.queries()["pipeline"](spark, str(tmp_path)).collect()}
    assert run == {(r["doc_id"], r["text"], tuple(r["ids"])) for r in d.collect()}


def test_waiting_workers_hold_no_freed_memory(spark):
    def held(pid):
        return sum(int(x.split()[1]) for x in open(f"/proc/{pid}/smaps_rollup") if x.startswith("Pss_Anon:")) / 1024

    def many_arrays(texts):
        arrays = [np.ones(8000) for _ in range(4000)]
        sys.kept_array = arrays[-1]  # lies above the freed ones
        at = held(os.getpid())
        return [[os.getpid()] * len(texts), [at] * len(texts)]

    fields = [T.StructField("pid", T.LongType()), T.StructField("mb", T.DoubleType())]
    row = textkit.map_texts(documents(spark, [(1, "one")]).coalesce(1), "text", fields, many_arrays).collect()[0]
    assert row["mb"] > 250 and held(row["pid"]) < row["mb"] - 200

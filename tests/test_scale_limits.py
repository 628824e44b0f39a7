"""Cases that once met a cap or lost rows."""

import numpy as np
from pyspark.sql import functions as F

from decision_lens.operators import clustering, reports, representativeness, sampling, similarity as S

SCHEMA = "vec_id long, prediction_id string, regeneration_number int, cluster_id int, embedding array<double>"


def test_order_stats_of_many_keys(spark):
    """24 000 vectors in 12 000 clusters; one pair in each."""
    rows = spark.range(24_000).select(
        F.col("id").alias("vec_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prediction_id"), F.lit(0).alias("regeneration_number"),
        (F.col("id") % 12_000).cast("int").alias("cluster_id"), F.array(F.lit(1.0), F.when(F.col("id") < 12_000, 0.0).otherwise(1.0)).alias("embedding"))
    out = S.order_stats(S.unit(rows), ["cluster_id"], ["intra_cluster"])
    row = out.agg(F.count(F.lit(1)), F.min("median"), F.max("median"), F.min("min"), F.max("max")).first()
    assert row[0] == 12_000 and all(abs(v - 0.5 ** 0.5) < 1e-9 for v in row[1:])


def block(idx, u, radius=0.0, paths=None, ks=("a",)):
    row = {"n": len(u), "home": "{}", "idx": idx, "ks": list(ks), "data": u.tobytes(), "p": np.arange(len(u)).tobytes(), "r": np.zeros(len(u), dtype=np.int64).tobytes(),
           "c": np.ones(len(u), dtype=np.int64).tobytes(), "centre": u.mean(axis=0).tobytes(), "radius": radius, "paths": paths}
    return S._Block(row)


def test_equal_vectors_come_back_as_one_value():
    b = block(0, np.tile([0.6, 0.8], (3000, 1)))
    counts = S._Counts(["intra_cluster"], True)
    counts.add(b, b)
    out = counts.table().to_pandas()
    assert len(out) <= 2 * 3 and out.groupby("target")["n"].sum().tolist() == [3000 * 2999 // 2] * 2


def test_blocks_beyond_the_searched_range_are_skipped():
    import json
    near, far = np.tile([1.0, 0.0], (5, 1)), np.tile([0.0, 1.0], (5, 1))
    middle = json.dumps([{"view": 0, "pair_class": "random_baseline", "target": t, "path": [{"low": -1.0, "width": 2.0, "chosen": 2048}]} for t in (0, 1)])
    a, b = block(0, near, paths=middle), block(1, far, paths=middle)
    assert a.matters(b, ["random_baseline"]) and not a.matters(a, ["random_baseline"])  # cosines 0 and 1; values near 0 are searched
    assert not a.matters(block(2, far, ks=("b",)), ["random_baseline"])


def test_clustered_vectors_send_few_tiles(spark, monkeypatch):
    """Two far groups of vectors: after the first count most tiles hold no value of the searched range."""
    monkeypatch.setattr(S, "TILE_BYTES", 1)
    rng = np.random.default_rng(1)
    base = np.eye(8)[np.repeat([0, 1, 2, 3], 40)] + 0.01 * rng.normal(size=(160, 8))
    rows = [(i, f"p{i}", 0, i // 40, f"g{i // 40}", "approved", v.tolist()) for i, v in enumerate(base)]
    df = S.unit(spark.createDataFrame(rows, "vec_id long, prediction_id string, regeneration_number int, cluster_id int, llm_name string, outcome string, embedding array<double>"))
    sent = []
    original = S.stage
    monkeypatch.setattr(S, "stage", lambda frame: sent.append(original(frame)) or sent[-1])
    out = S.view_stats(df, ["llm_name"], [("llm_name",)], ["random_baseline"], block_rows=10, ranked_values=50).collect()
    assert len(out) == 4
    u = np.array([r["u"] for r in df.orderBy("vec_id").collect()])
    for r in out:
        g = int(r["k"][-3])
        cos = (u[g * 40:(g + 1) * 40] @ u[g * 40:(g + 1) * 40].T)[np.triu_indices(40, 1)]
        assert abs(r["median"] - np.median(cos)) < 1e-12 and abs(r["min"] - cos.min()) < 1e-12
    # views over everything: the median lies between far groups, so tiles of one group are left out
    sent.clear()
    S.view_stats(df, ["llm_name"], [()], ["random_baseline"], block_rows=10, ranked_values=50).collect()
    tiles = [f.count() for f in sent if f.columns == ["home", "i", "j"]]
    assert tiles and tiles[-1] < 16 * 17 // 2


def test_unlisted_generators_keep_their_columns(spark):
    long = spark.createDataFrame([("m", "gen-a", 1.0), ("m", "new", 3.0)], "metric string, llm_name string, value double")
    assert reports.metric_table(long, ["gen-a", "gen-b"]).first().asDict() == {"metric": "m", "gen-a": 1.0, "gen-b": None, "new": 3.0}
    stats = spark.createDataFrame([("by_llm_outcome", "new", "approved", "intra_cluster", 2, 0.5)],
                                  "grouping string, llm_name string, outcome string, pair_class string, count long, mean double")
    assert reports.similarity_table(stats, ["gen-a"]).first()["new"] == "0.500"
    texts = spark.createDataFrame([("new", ["age"])], "llm_name string, f array<string>")
    assert reports.mention_pivot(texts, F.col("f"), ["gen-a"]).first()["new"] == 100.0


def test_samples_of_many_clusters(spark):
    df = spark.range(60_000).select(F.col("id").alias("row_id"), (F.col("id") % 30_000).alias("cluster_id"))
    assert sampling.cluster_sample(df, "row_id", 40_000).count() == 40_000
    out = sampling.cluster_sample(df, "row_id", 30_000)
    assert out.count() == 30_000 and out.select("cluster_id").distinct().count() == 30_000


def test_rows_with_missing_values_are_clustered(spark):
    df = spark.createDataFrame([(None, 1.0), (5.0, None), (2.0, 2.0)], "a double, b double")
    assert clustering.assembled(df, ["a", "b"]).count() == 3


def test_unknown_ages_have_a_band(spark):
    df = spark.createDataFrame([("18-35", 1, 0.9), ("Unknown", 0, 0.2)], "age_group string, prediction int, probability double")
    got = {r["age_band"]: r["population_probability"] for r in representativeness.age_band_means(df, df.limit(0), F.col("age_group")).collect()}
    assert got == {"18-35": 0.9, "Unknown": 0.2}


def test_hot_prediction_is_not_shuffled(spark):
    """A third of all rows on one id: same rows as a plain join, and the hot rows meet a broadcast."""
    from decision_lens.functions.joins import join_hot
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("prediction_id"), "id").unionByName(
        spark.createDataFrame([(None, -1), ("none", -2)], "prediction_id string, id long"))
    right = spark.range(2000).select(F.col("id").cast("string").alias("prediction_id"), (F.col("id") * 2).alias("v")).unionByName(
        spark.createDataFrame([("hot", 7), ("hot", 8)], "prediction_id string, v long"))
    for how in ("inner", "left"):
        got, want = join_hot(left, right, "prediction_id", how, least=500), left.join(right, "prediction_id", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_hot(left, right, "prediction_id", "left", least=500)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Union" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin [prediction_id" in plan
    assert join_hot(left, right, "prediction_id").count() == left.join(right, "prediction_id").count()


def test_brackets_narrow_until_they_are_small(spark, monkeypatch):
    """Bounds that force several sketches inside each other; quantiles stay exact, also among ties."""
    from decision_lens.functions import quantiles as Q
    calls = []
    original = Q._narrowed
    monkeypatch.setattr(Q, "_narrowed", lambda *a: calls.append(original(*a)) or calls[-1])
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=30_000), "b": np.repeat([1.0, 2.0, 5.0], 10_000)}
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(values["a"], values["b"])], "a double, b double")
    got = Q.exact_quantiles(df, ["a", "b"], [0.01, 0.25, 0.5, 0.99], accuracy=50, margin=0.2, bracket_rows=20).collect()
    for r in got:
        assert r["quantile"] == np.quantile(values[r["feature"]], r["prob"]), (r["feature"], r["prob"])
    small = calls[0][0].filter("_k0 = 'a'").collect()
    inside = [((values["a"] >= r["lo"]) & (values["a"] <= r["hi"])).sum() for r in small]
    assert max(inside) < 3000 and len(got) == 8  # the first brackets held over 10 000 values


def test_cut_buckets_are_split_again(spark):
    from decision_lens.functions.sampling import split_by_hash
    df = spark.range(9000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("s"))
    quotas = {"0": 1000, "1": 17, "2": 3000}
    plain = split_by_hash(df, "row_id", quotas, F.col("s"))
    deep = split_by_hash(df, "row_id", quotas, F.col("s"), digits=1, bucket_rows=5)
    ids = lambda frame: sorted(r["row_id"] for r in frame.collect())
    assert ids(plain[0]) == ids(deep[0]) and len(ids(deep[0])) == 4017 and ids(plain[1]) == ids(deep[1])


def test_texts_of_a_batch_are_counted_in_pieces(monkeypatch):
    """Memory beside the batch is bounded; runs over the end of a piece count once."""
    import tracemalloc

    import pyarrow as pa

    from decision_lens.functions import text
    batch = pa.array(["one two. " * 800_000, "", "three"] * 3)
    tracemalloc.start()
    got = text.run_counts(batch).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:3] == [{"words": 1_600_000, "sentences": 800_000, "vowels": 1_600_000 + 800_000}, {"words": 0, "sentences": 0, "vowels": 0}, {"words": 1, "sentences": 0, "vowels": 1}]
    assert batch.nbytes > 20 << 20 and peak < 16 << 20
    monkeypatch.setattr(text, "PIECE_BYTES", 3)
    odd = pa.array(["xx", "aaee  b", "b..!c", "", "éa a"])
    assert [tuple(x.values()) for x in text.run_counts(odd).to_pylist()] == [(1, 0, 0), (2, 0, 1), (1, 1, 0), (0, 0, 0), (2, 0, 2)]


def test_repair_holds_no_steps_of_long_strings():
    """A long string is one token, taken without a state for each of its characters."""
    import json
    import resource

    from decision_lens.functions import text
    body = "word " * 2_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert text._balanced('{"a": "' + body)[1].endswith('"}')
    assert json.loads(text._tidy('{"a": "' + body + '",}', False)) == {"a": body}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


def test_responses_are_parsed_only_for_metrics_of_texts(spark, monkeypatch):
    from decision_lens.plans import explanation_data as data
    found = data.predictions_for_grading(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(data, "predictions_for_grading", lambda *_: found)
    parsed = []
    monkeypatch.setattr(data.salvage, "salvage_responses", lambda df, f=data.salvage.salvage_responses: parsed.append(1) or f(df))
    data.graded(spark, "/root/testdata/sf0.001", ["checklist"])
    assert not parsed
    assert "fidelity" in data.graded(spark, "/root/testdata/sf0.001", ["fidelity"]).columns and parsed


def test_lower_case_is_made_once_a_row(spark):
    from decision_lens.operators import metrics
    df = spark.createDataFrame([("Your AGE and monthlyincome, DebtRatio",), (None,)], "consumer_text string").coalesce(1)
    out = metrics.evaluate(df, ["regulatory", "immutable", "technical"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    first, empty = out.collect()
    assert out.columns == ["consumer_text", "feature_name_matching", "immutable_mentions", "technical_mentions"]
    assert first["technical_mentions"] == ["MonthlyIncome", "DebtRatio"] and first["immutable_mentions"][0]["term_found"] == "age" and not empty["immutable_mentions"]


def test_only_predictions_with_explanations_are_searched(spark):
    from decision_lens.plans import explanation_data as data, models
    sf = "/root/testdata/sf0.001"
    asked = {r["prediction_id"] for r in data.explanations(spark, sf).select("prediction_id").collect()}
    every = {r["prediction_id"]: r["counterfactuals"] for r in models.explained(spark, sf).collect()}
    found = {r["prediction_id"]: r["counterfactuals"] for r in data.predictions_for_grading(spark, sf).collect()}
    assert set(found) == asked & set(every) and len(found) < len(every)
    assert all(every[k] == v for k, v in found.items())  # grid and percentiles are those of all applicants

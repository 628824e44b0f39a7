import json

import pytest
from pyspark.sql import functions as F, types as T

from decision_lens.sources import readers as R, tables as B


def write(tmp_path, name, value):
    p = tmp_path / name
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


def prediction(pid, prob, cfs):
    return {"prediction": {"prediction_id": pid, "prediction": int(prob > 0.5), "probability": prob,
                           "input_data": {"age": 40.0, "MonthlyIncome": None}, "timestamp": "t"},
            "cluster_id": 2, "shap_explanation": {"baseline": -1.0, "contributions": {"age": 0.25}}, "counterfactuals": cfs}


CF = {"DebtRatio": {"from": 1.0, "to": 0.5, "diff": -0.5, "percentile_change": -12.0}, "age": {"percentile_change": 99.0}}


def test_predictions_as_map_and_list(spark, tmp_path):
    a, b = prediction("a", 0.9, [CF, CF]), prediction("b", 0.1, [{"info": "none"}])
    as_map = write(tmp_path, "m.json", {"metadata": {}, "predictions": {"x": a, "b": b}})
    as_list = write(tmp_path, "l.json", {"predictions": [prediction("a", 0.2, []), a, b]})
    for path in (as_map, as_list):
        got = {r["prediction_id"]: r for r in R.flat_predictions(R.predictions(spark, path)).collect()}
        assert set(got) == {"a", "b"} and got["a"]["probability"] == 0.9
        assert (got["a"]["cf_count"], got["a"]["cf_avg_percentile_change"]) == (2, 12.0)
        assert (got["b"]["cf_count"], got["b"]["cf_count_raw"], got["b"]["cf_avg_percentile_change"]) == (0, 1, 0.0)
        assert got["a"]["input_age"] == 40.0 and got["a"]["shap_age"] == 0.25 and got["a"]["cluster_id"] == 2


def test_explanations_and_results_shapes(spark, tmp_path):
    e = {"explanation_id": "e1", "prediction_id": "p", "llm_name": "g", "token_usage": {"total_tokens": 3}}
    for name, doc in (("o.json", {"explanations": [e]}), ("b.json", [e])):
        assert R.explanations(spark, write(tmp_path, name, doc)).first()["token_usage"]["total_tokens"] == 3
    r = {"evaluation_result": {"cemat_evaluation": {"understandability_items": {"item_1": 1}}}, "metadata": {"explanation_id": "e1"}, "batch_index": 4}
    for name, doc in (("r1.json", {"results": [r, r]}), ("r2.json", [r]), ("r3.json", r)):
        rows = R.batch_results(spark, write(tmp_path, name, doc)).collect()
        assert rows[0]["metadata"]["explanation_id"] == "e1" and rows[0]["evaluation_result"]["cemat_evaluation"]["understandability_items"] == {"item_1": "1"}


def test_raw_responses_clusters_and_priority(spark, tmp_path):
    line = {"response": {"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}, "custom_metadata": {"explanation_id": "e"}}
    got = R.judge_responses(spark, write(tmp_path, "j.jsonl", json.dumps(line) + "\n" + "{}")).collect()
    assert (got[0]["judge_text"], got[0]["explanation_id"], got[1]["judge_text"]) == ("hi", "e", None)
    c = R.cluster_assignments(spark, write(tmp_path, "c.json", {"index_to_cluster": {"7": 3}}))
    assert [tuple(r) for r in c.collect()] == [(7, 3)] and R.cluster_assignments(spark, None).count() == 0
    a = spark.createDataFrame([("x", 1)], "explanation_id string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "explanation_id string, v int")
    assert {tuple(r) for r in R.results_by_priority(a, b).collect()} == {("x", 1), ("y", 3)}
    assert R.with_fallback(a.limit(0), b).count() == 2 and R.with_fallback(a, b).count() == 1


def test_applicant_csv_and_frozen(spark, tmp_path):
    head = "Unnamed: 0,SeriousDlqin2yrs,RevolvingUtilizationOfUnsecuredLines,age,NumberOfTime30-59DaysPastDueNotWorse,DebtRatio,MonthlyIncome,NumberOfOpenCreditLinesAndLoans,NumberOfTimes90DaysLate,NumberRealEstateLoansOrLines,NumberOfTime60-89DaysPastDueNotWorse,NumberOfDependents"
    r = R.applicants_csv(spark, write(tmp_path, "a.csv", head + "\n1,0,0.5,45,2,0.8,NA,13,0,6,0,2\n")).first()
    assert (r["row_id"], r["income"], r["late_30_59"], r["dependents"]) == (1, "NA", 2.0, 2.0)
    f = R.frozen_parameters('{"trimmed_values": {"DebtRatio": [0, 2]}, "dropped_columns": ["x"]}')
    assert f.caps == {"debt_ratio": (0.0, 2.0)} and f.median_income == 5400.0 and f.dropped_columns == ("x",)


def test_flatten(spark):
    df = spark.createDataFrame([((1, (2,)),)], "a struct<b:int,c:struct<`d-e`:int>>")
    assert R.flatten(df, {"a_b": "z"}).first().asDict() == {"z": 1, "a_c_d-e": 2}


ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])


def test_keyed_table(spark, tmp_path):
    t = B.KeyedTable(spark, str(tmp_path / "t"), ROW, "k").create()
    put = lambda rows, **kw: t.put(spark.createDataFrame(rows, ROW), **kw)
    assert put([("a", 1), ("a", 5), ("b", 2), (None, 9)], order="v") == 1
    put([("b", 3), ("c", 4)], overwrite=False)
    assert {tuple(r) for r in t.create().read().collect()} == {("a", 5), ("b", 2), ("c", 4)}
    put([("b", 7)])
    assert [tuple(r) for r in t.get("b").collect()] == [("b", 7)]
    assert t.read(limit=0).count() == 0 and t.keys().count() == 3
    plan = t.get("b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,b)" in plan
    t.clear()
    assert t.read().count() == 0


def test_create_leaves_other_data_alone(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "home" / "one"))
    spark.range(4).write.parquet(str(tmp_path / "home" / "two"))
    with pytest.raises(Exception):
        B.KeyedTable(spark, str(tmp_path / "home"), ROW, "k").create()
    assert spark.read.parquet(str(tmp_path / "home" / "two")).count() == 4


def test_grouped_store_splits_big_groups(spark):
    rows = [("hot", i) for i in range(100)] + [("small", 1), (None, 2)]
    df, counts = B.grouped_store(spark.createDataFrame(rows, "g string, i int"), "g", "i", part_rows=20)
    got = df.collect()
    assert sorted(x["i"] for r in got if r["g"] == "hot" for x in r["items"]) == list(range(100))
    assert len([r for r in got if r["g"] == "hot"]) > 3
    assert counts.first().asDict() == {"stored": 101, "failed": 1}


def test_storable_and_results(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), {"a": float("inf")}), (1.5, {"a": -2.0})], "x double, m map<string,double>").coalesce(1)
    got = B.storable(df).collect()
    assert [r["x"] for r in got] == ["NaN", "1.5"] and got[0]["m"] == {"a": "Infinity"}
    B.write_results(df.select("x"), str(tmp_path / "r"), "csv")
    with pytest.raises(ValueError):
        B.write_results(df, str(tmp_path / "r2"), "xml")


def test_other_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.0, 1)], "row_id long, cluster_id int, age double, label int")
    B.write_clusters(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/distribution")).first()["share"] == 1.0
    B.write_training_set(df, ["age"], "label", str(tmp_path / "x"))
    assert R.processed_csv(spark, str(tmp_path / "x/x"), str(tmp_path / "x/y")).first()["label"] == 1
    B.write_evaluations(df, df, str(tmp_path / "e"))
    B.write_metadata(spark, str(tmp_path / "meta"), {"a": 1})
    assert json.loads(spark.read.text(str(tmp_path / "meta")).first()[0]) == {"a": 1}
    requests = df.select(F.lit("request-1").alias("key"), F.struct("row_id").alias("request"))
    B.write_requests(requests, str(tmp_path / "q"))
    assert json.loads(spark.read.text(str(tmp_path / "q")).first()[0])["request"] == {"row_id": 1}


def nested(n, seed):
    import random
    r = random.Random(seed)
    text = lambda: "".join(r.choice(['a', 'é', '{', '}', '[', ']', ',', ':', '"', '\\', '\n', ' ', "'"]) for _ in range(r.randint(0, 30)))
    return [{"id": i, text() + "k": text(), "deep": {"x": [text(), {"y": text()}], "z": {}}, "e": [], "n": None} for i in range(n)]


@pytest.mark.parametrize("cut", ["}", ","])
@pytest.mark.parametrize("size", ["200", "3000", "128m"])
def test_documents_are_cut_at_elements(spark, tmp_path, cut, size):
    """Any cut and split size gives the elements that a JSON parser finds, in order."""
    from decision_lens.sources.documents import elements
    many = nested(60, 7)
    docs = {"a.json": {"meta": {"p": "}{,"}, "count": 3, "results": many, "other": [1, 2]}, "b.json": many[:20], "c.json": {"x": {}, "results": []},
            "d.json": {"predictions": {m["deep"]["x"][0] + str(i): m for i, m in enumerate(many[:9])}, "results": many[:1]}, "e.json": []}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1 if name == "a.json" else None, ensure_ascii=name == "d.json"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if size != "128m" else "4m")
    try:
        rows = elements(spark, str(tmp_path), cut).orderBy("source_order").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in rows:
        found.setdefault((r["source_order"]["path"][-6:], r["member"]), []).append(r["value"])
    parsed = {k: [json.loads(v) for v in vs] for k, vs in found.items() if k[1] not in ("predictions", "meta")}
    assert parsed == {("a.json", "results"): many, ("a.json", "other"): [1, 2], ("b.json", ""): many[:20], ("d.json", "results"): many[:1]}
    named = {}
    for v in found["d.json", "predictions"]:
        named.update(json.loads("{" + v + "}"))
    assert named == docs["d.json"]["predictions"]


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    from decision_lens.sources.documents import fragments
    record = {"results": [{"evaluation_result": None, "metadata": {"explanation_id": f"e{i}", "llm_name": "x" * 200}, "batch_index": i} for i in range(4000)]}
    path = write(tmp_path, "big.json", record)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert fragments(spark, path, "}").rdd.getNumPartitions() > 8
        got = R.batch_results(spark, path, ordered=True).orderBy("source_order").select("batch_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["batch_index"] for r in got] == list(range(4000))


def test_later_duplicate_wins_across_files(spark, tmp_path):
    for name, p in (("a.json", [0.1, 0.2]), ("b.json", [0.3, 0.4])):
        write(tmp_path, name, {"predictions": [prediction("x", v, []) for v in p]})
    assert [r["record"]["prediction"]["probability"] for r in R.predictions(spark, str(tmp_path)).collect()] == [0.4]
    lines = tmp_path / "lines"
    lines.mkdir()
    for name, p in (("a.jsonl", [0.5, 0.6]), ("b.jsonl", [0.8, 0.7])):
        write(lines, name, "\n".join(json.dumps(prediction("x", v, [])) for v in p))
    assert [r["record"]["prediction"]["probability"] for r in R.predictions(spark, str(lines), lines=True).collect()] == [0.7]


def test_written_documents_come_back(spark, tmp_path):
    from decision_lens.sources.documents import elements, write_documents
    rows = spark.range(50).select(F.concat(F.lit('q"\\ü'), F.col("id").cast("string")).alias("k"), F.to_json(F.struct("id")).alias("value"))
    for i, (member, key) in enumerate([(None, None), ("results", None), ("predictions", "k")]):
        write_documents(rows, str(tmp_path / str(i)), member, key=key)
        got = elements(spark, str(tmp_path / str(i))).where(F.col("member").isin("", "results", "predictions")).collect()
        assert len(got) == 50
        if key:
            assert {k for r in got for k in json.loads("{" + r["value"] + "}")} == {f'q"\\ü{i}' for i in range(50)}


def files_of(df):
    return set(df.inputFiles())


def test_get_reads_one_bucket_and_compaction_bounds_reads(spark, tmp_path):
    t = B.KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=8).create()
    for i in range(5):
        t.put(spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.lit(i).alias("v")))
    plan = t.get("k7")._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(k,k7)" in plan
    assert [tuple(r) for r in t.get("k7").collect()] == [("k7", 4)]
    assert max(len([f for f in d.iterdir() if f.suffix == ".parquet"]) for d in (tmp_path / "t").glob("_bucket=*")) <= 5
    before = {tuple(r) for r in t.read().collect()}
    assert len(files_of(t.read())) > 30
    t.compact()
    assert len(files_of(t.read())) <= 8 and {tuple(r) for r in t.read().collect()} == before and t._raw().count() == 200
    t.put(spark.createDataFrame([("k7", 9)], ROW))
    assert t.get("k7").first()["v"] == 9 and t.get("k8").first()["v"] == 4 and t.get("none").count() == 0


def test_puts_without_order_do_not_depend_on_partitions(spark, tmp_path):
    rows = [("a", i) for i in range(40)]
    got = []
    for n in (1, 7):
        t = B.KeyedTable(spark, str(tmp_path / f"t{n}"), ROW, "k").create()
        t.put(spark.createDataFrame(rows, ROW).repartition(n))
        got.append([tuple(r) for r in t.read().collect()])
    assert got[0] == got[1] and len(got[0]) == 1
    assert [r["v"] for r in B.KeyedTable(spark, str(tmp_path / "t1"), ROW, "k").read(limit=1, order=["v"]).collect()] == [got[0][0][1]]


def test_storable_reaches_nested_values(spark):
    df = spark.createDataFrame([((float("nan"), [1.5, float("inf")]), [{"a": float("-inf")}], 3)], "s struct<x:double,l:array<double>>, m array<map<string,double>>, n int").coalesce(1)
    r = B.storable(df).first()
    assert (r["s"]["x"], r["s"]["l"], r["m"], r["n"]) == ("NaN", ["1.5", "Infinity"], [{"a": "-Infinity"}], 3)


def test_models_are_kept(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    from decision_lens.operators import training
    df = spark.createDataFrame([(float(i), float(i % 3), i % 2) for i in range(30)], "a double, b double, label int")
    model = training.fit_pipeline(df, ["a", "b"], LogisticRegression(labelCol="label"))
    B.write_model(spark, model, str(tmp_path / "m"), {"features": ["a", "b"]})
    again, meta = B.read_model(spark, str(tmp_path / "m"))
    assert meta == {"features": ["a", "b"]}
    assert training.score_model(df, again).collect() == training.score_model(df, model).collect()

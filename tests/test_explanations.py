import pytest
from pyspark.sql import functions as F

from decision_lens.functions.text import with_readability
from decision_lens.operators import metrics as M, salvage, verification as V, worklist as W
from decision_lens.operators.counterfactual import display_value
from decision_lens.plans.adapters import FROZEN
from decision_lens.schemas import FEATURE_COLUMNS

GOOD = '{"consumer_explanation": "See http://x.org/#a, {ok}", "analysis": {"top_features": ["age", "monthly income"]}}'
CASES = {
    "direct": GOOD,
    "fenced": f"Sure:\n```json\n{GOOD}\n```\nbye",
    "embedded": f"Here you go: {GOOD} // done",
    "control_chars": GOOD.replace('"analysis"', '\x02"analysis"'),
    "tidied": GOOD.replace("]}}", ",],},}"),
    "closed": GOOD[:-2],
    "pattern": '"consumer_explanation": "plain \\"words\\"" and "top_features": ["a","b","c","d","e","f"',
    "failed": "No structure at all.",
}


def test_salvage_stages(spark):
    df = spark.createDataFrame([(k, v) for k, v in CASES.items()] + [("failed2", ""), ("failed3", None), (
        "failed4", '{"consumer_explanation": 5}')], "explanation_id string, explanation_text string")
    got = {r["explanation_id"]: r for r in salvage.salvage_responses(df).collect()}
    for stage in CASES:
        assert got[stage]["parse_stage"] == stage
    for stage in ("direct", "fenced", "embedded", "control_chars", "tidied", "closed"):
        assert got[stage]["consumer_explanation"] == "See http://x.org/#a, {ok}", stage
        assert got[stage]["top_features"] == ["age", "monthly income"], stage
    assert got["pattern"]["consumer_explanation"] == 'plain "words"' and got["pattern"]["top_features"] == list("abcde")
    assert {got[f"failed{i}"]["parse_stage"] for i in (2, 3, 4)} == {"failed"}
    assert salvage.quarantine(salvage.salvage_responses(df)).count() == 4


LOOSE = {
    "{'consumer_explanation': 'It\\'s plain, isn't it', 'analysis': {'top_features': ['age', \"debt\"]}}": ("It's plain, isn't it", ["age", "debt"]),
    'consumer_explanation: "Loose words", top_features: ["a", "b"': ("Loose words", ["a", "b"]),
    "Result \"consumer_explanation\": \"never closed, the rest": ("never closed, the rest", []),
    'The model said "Your request was declined today" and more.': ("Your request was declined today", []),
    "They wrote 'it was declined, sorry' there": ("it was declined, sorry", []),
    "Dear all. I fear we have\n declined this. First reason. Second. Third. Fourth. Fifth. Sixth.": ("we have declined this. First reason. Second. Third. Fourth. Fifth.", []),
    "Thank you for asking, we are unable to help. Bye.": ("Thank you for asking, we are unable to help. Bye.", []),
    "Hello, we regret it! Really. 'top_features': ['x', 'y'].": ("Hello, we regret it! Really. 'top_features': ['x', 'y'].", ["x", "y"]),
    "Sadly declined. One. Two. Three. Four.": ("Sadly declined. One. Two. Three.", []),
    'She said "' + "long " * 12 + '" once': (("long " * 12), []),
    'Short "quote" only': None, "it was not approved": None, "'": None, '"': None,
}


def test_loose_responses(spark):
    df = spark.createDataFrame([(k,) for k in LOOSE], "explanation_text string").withColumn("explanation_id", F.col("explanation_text"))
    got = {r["explanation_id"]: r for r in salvage.salvage_responses(df).collect()}
    for text, want in LOOSE.items():
        r = got[text]
        assert (None if r["parse_stage"] == "failed" else (r["consumer_explanation"], r["top_features"])) == want, text


def judge(principal='{"score": 1}', extra="", cemat='"item_1": 1, "item_2": "N/A"', target='"12.5"'):
    return ('{"cemat_evaluation": {"understandability_items": {%s}, "actionability_items": {}}, "regulatory_compliance": '
            '{"principal_reason_identification": %s, "individual_specific_content": {"score": 0}}, '
            '"counterfactual_extraction": {"changes": [{"feature_name": "MonthlyIncome", "target_value": %s}]}%s}'
            % (cemat, principal, target, extra))


def test_salvage_judgements(spark):
    rows = {"a": judge(), "bare": judge("1"), "range": judge('{"score": 3}'), "na": judge(cemat='"item_1": N/A'),
            "comment": judge().replace("{", "{ // it's {odd} # \n", 1), "text": judge(target='"soon"'), "bad": "sorry",
            "url": judge(extra=', "note": "http://a.b/#c"')}
    df = spark.createDataFrame(list(rows.items()), "k string, judge_text string")
    got = {r["k"]: r for r in salvage.salvage_judgements(df).collect()}
    assert got["a"]["principal_reason_identification"] == got["bare"]["principal_reason_identification"] == 1
    assert got["a"]["technical_jargon_check"] == 0 and got["a"]["violation"] is None
    assert got["range"]["violation"] == "marker out of range" and got["bad"]["violation"] == "unparsed"
    assert got["na"]["understandability_items"] == {"item_1": "N/A"} and got["na"]["parse_stage"] == "tidied"
    assert got["comment"]["violation"] is None and got["url"]["parse_stage"] == "direct"
    assert got["a"]["changes"][0]["target_value"] == 12.5 and got["text"]["changes"][0]["target_value"] is None


def test_checklist(spark):
    df = spark.createDataFrame([({"a": "1", "b": "0", "c": "N/A", "d": None}, {"e": "1"}), ({"a": "n/a"}, {"b": "N/A"}), ({}, {})],
                               "u map<string,string>, a map<string,string>").coalesce(1)
    got = [r[0] for r in df.select(M.checklist(F.col("u"), F.col("a"))).collect()]
    assert (got[0]["understandability_score"], got[0]["overall_score"], got[0]["understandability_applicable"]) == (0.5, 2 / 3, 2)
    assert [g["overall_score"] for g in got[1:]] == [0.0, 0.0]


def test_fidelity_cases(spark):
    top = ["age", "DebtRatio", "MonthlyIncome", "NumberOfDependents", "imputed_income"]
    lists = {"same": top, "friendly": ["age", "debt-to-income ratio", "monthly income"], "reversed": top[::-1],
             "two": ["DebtRatio", "x", "age"], "one": ["age"], "none": ["x"], "repeat": ["MonthlyIncome", "MonthlyIncome", "age", "age"],
             "empty": []}
    df = spark.createDataFrame([(k, v, top) for k, v in lists.items()], "k string, l array<string>, t array<string>")
    got = {r["k"]: r["f"] for r in df.select("k", M.fidelity(F.col("l"), F.col("t")).alias("f")).collect()}
    assert got["same"]["score"] == 1.0 and got["same"]["p_value"] == 0.0 and got["same"]["matching_features"] == 5
    assert got["friendly"]["score"] == 1.0 and got["reversed"]["score"] == -1.0
    assert got["two"]["score"] == -1.0 and got["two"]["p_value"] is None
    assert got["one"]["error"] == got["none"]["error"] == "insufficient common features" and got["one"]["score"] == 0.0
    assert got["repeat"]["score"] == -1.0 and got["repeat"]["matching_features"] == 2
    assert got["empty"]["error"] == "no features to compare"


@pytest.mark.parametrize("n,r,p", [(3, 0.5, 2 / 3), (4, 0.8, 0.2), (5, 0.9, 0.03738607346849863)])
def test_spearman_p(spark, n, r, p):
    got = spark.range(1).select(M.spearman_p(F.lit(r), F.lit(n))).first()[0]
    assert got == pytest.approx(p, abs=1e-9)


def test_mentions_respect_word_bounds(spark):
    df = spark.createDataFrame([("Your AGE matters",), ("the average package",), ("family size and kids",), ("pré_age",), ("DebtRatio: NumberOfTime30-59DaysPastDueNotWorse.",)],
                               "t string").coalesce(1)
    got = [[m["term_found"] for m in r[0]] for r in df.select(M.immutable_mentions(F.col("t"))).collect()]
    assert got == [["age"], [], ["family size"], [], []]
    assert df.select(M.technical_mentions(F.col("t"))).collect()[4][0] == ["DebtRatio", "NumberOfTime30-59DaysPastDueNotWorse"]
    assert df.select(M.technical_substrings(F.col("t"))).collect()[4][0] == 2


def test_readability_blank_and_simple(spark):
    df = spark.createDataFrame([("",), ("The cat sat.",)], "t string").coalesce(1)
    got = [r["readability"] for r in with_readability(df, "t").collect()]
    assert got[0] is None
    assert got[1]["flesch_reading_ease"] == pytest.approx(206.835 - 1.015 * 3 - 84.6)


def test_name_resolution(spark):
    names = {"DebtRatio": "DebtRatio", "DebtRatio_log": "DebtRatio", "monthly income": "MonthlyIncome",
             "Days late 30_59": "NumberOfTime30-59DaysPastDueNotWorse", "Days 60-89": "NumberOfTime60-89DaysPastDueNotWorse",
             "Days 90+": "NumberOfTimes90DaysLate", "My real estate": "NumberRealEstateLoansOrLines", "credit score": None, "x_log": None}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", V.resolve_name(F.col("n"))).collect()} == names


def test_suggestion_scores(spark):
    base = {c: 0.0 for c in FEATURE_COLUMNS} | {"late_90": 3.0, "income": 1000.0, "utilisation": 1.0}
    columns = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    cf = [{"changes": [{"feature": "NumberOfTimes90DaysLate", "to": 2.9}]}]
    def row(k, prediction, changes):
        return (k, prediction, 0.9, *base.values(), [(n, t) for n, t in changes], cf)
    rows = [row("approved", 0, [("MonthlyIncome", 1.0)]), row("nothing", 1, []), row("null", 1, [("MonthlyIncome", None)]),
            row("match", 1, [("NumberOfTimes90DaysLate", 2.9)]),
            row("flip", 1, [("NumberOfTimes90DaysLate", 0.0), ("MonthlyIncome", 20000.0), ("credit card usage", 0.0)]),
            row("last", 1, [("NumberOfTimes90DaysLate", 0.0), ("NumberOfTimes90DaysLate", 2.9)])]
    df = spark.createDataFrame([(r[0], r[1], r[2], *r[3:-2], [{"feature_name": n, "target_value": t} for n, t in r[-2]], r[-1]) for r in rows],
                               f"k string, prediction int, probability double, {columns}, changes array<struct<feature_name:string,target_value:double>>, "
                               "counterfactuals array<struct<changes:array<struct<feature:string,to:double>>>>")
    got = {r["k"]: r for r in V.verify_suggestions(df, FROZEN).collect()}
    assert got["approved"]["cf_score"] is None and got["approved"]["cf_skipped"]
    assert got["nothing"]["cf_score"] == got["null"]["cf_score"] == 0.0
    assert got["match"]["cf_score"] == pytest.approx(0.2) and got["match"]["cf_match_index"] == 1
    assert got["flip"]["cf_score"] == 1.0 and got["flip"]["cf_flipped"] and got["flip"]["cf_improved"]
    assert got["last"]["cf_match_index"] == 1


@pytest.mark.parametrize("column,raw,before,after,want", [
    ("age", 40.0, 1.0, 2.0, 40.0), ("income", 100.0, 1.0, 1.0 + 1e-9, 100.0), ("income", 100.0, 1.0, 50.0, 1000.0),
    ("open_lines", 5.0, 2.0, 1.0, 2.0), ("late_90", 0.0, 0.0, -3.0, 0.0), ("income", 20000.0, 1.0, 2.0, 23000.0)])
def test_display_value(spark, column, raw, before, after, want):
    got = spark.range(1).select(display_value(column, F.lit(raw), F.lit(before), F.lit(after), FROZEN.caps)).first()[0]
    assert got == pytest.approx(want)


def test_work_list_resume_is_an_anti_join(spark):
    work = W.work_list(spark.createDataFrame([("p1",), ("p2",)], "prediction_id string"), ["g1", "g2"], 3)
    assert work.count() == 12
    stored = spark.createDataFrame([("p1_exp_1_g1",)], "explanation_id string")
    left = W.remaining(work, stored)
    assert left.count() == 11 and "LeftAnti" in left._jdf.queryExecution().executedPlan().toString()


def test_text_formats(spark):
    cfs = "array<struct<changes:array<struct<feature:string,`from`:double,`to`:double,diff:double>>>>"
    change = {"feature": "MonthlyIncome", "from": 1000.0, "to": 1201.0, "diff": 201.0}
    other = {"feature": "DebtRatio", "from": 0.5, "to": 0.129, "diff": -0.371}
    df = spark.createDataFrame([([{"changes": [change, other]}],), ([],), (None,), ([{"changes": []}],)], f"c {cfs}").coalesce(1)
    got = [r[0] for r in df.select(W.counterfactual_text(F.col("c"))).collect()]
    assert got[0] == ("Scenario 1:\nmonthly income: 1000.000000 → 1210.00 (change: +201.0000)\n"
                      "debt-to-income ratio: 0.500000 → 0.12 (change: -0.3710)")
    assert got[1] == got[2] == "No counterfactual scenarios available."
    assert got[3] == "No valid counterfactual scenarios available."
    for x in (0.00015, 0.12345, -2.00025, 1234.5):
        assert spark.range(1).select(W.fixed_point(F.lit(x), 4)).first()[0] == f"{x:.4f}"


def test_metric_summary_population_std(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 3.0), ("b", "m", None), ("b", "m", 5.0)], "llm_name string, metric string, value double")
    got = {r["llm_name"]: (r["mean"], r["std"], r["count"]) for r in M.metric_summary(df).collect()}
    assert got["a"] == (2.0, 1.0, 2) and got["b"] == (5.0, 0.0, 1) and got[None][2] == 3

"""Feature dimension, fixed values and record schemas.

Columns use snake_case inside the library; the technical names of the applicant
files and the reader-facing names are mapped at the edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: feature names -----------------------------------------------------------
# column, technical name, reader-facing name (None: no friendly name)
FEATURES = (
    ("age", "age", "age"),
    ("dependents", "NumberOfDependents", "number of dependents"),
    ("income", "MonthlyIncome", "monthly income"),
    ("debt_ratio", "DebtRatio", "debt-to-income ratio"),
    ("open_lines", "NumberOfOpenCreditLinesAndLoans", "number of open credit lines"),
    ("real_estate", "NumberRealEstateLoansOrLines", "real estate loans"),
    ("utilisation", "RevolvingUtilizationOfUnsecuredLines", "credit card usage"),
    ("late_30_59", "NumberOfTime30-59DaysPastDueNotWorse", "recent late payments (30-59 days)"),
    ("late_60_89", "NumberOfTime60-89DaysPastDueNotWorse", "recent late payments (60-89 days)"),
    ("late_90", "NumberOfTimes90DaysLate", "serious late payments (90+ days)"),
    ("imputed_income", "imputed_income", None),
)
FEATURE_COLUMNS = [f[0] for f in FEATURES]
TECHNICAL = {f[0]: f[1] for f in FEATURES}
COLUMN_OF = {f[1]: f[0] for f in FEATURES}
FRIENDLY = {f[0]: f[2] or f[1] for f in FEATURES}
TECHNICAL_OF_FRIENDLY = {f[2]: f[1] for f in FEATURES if f[2]}

LATE_COLUMNS = ["late_30_59", "late_60_89", "late_90"]
LATE_SENTINELS = (96.0, 98.0)
MISSING_INCOME_TEXT = ("NA", "N/A", "n/a")
COUNT_COLUMNS = ["dependents", "open_lines", "real_estate", *LATE_COLUMNS]
IMMUTABLE_COLUMNS = ["age", "dependents", "imputed_income"]
MUTABLE_COLUMNS = [c for c in FEATURE_COLUMNS if c not in IMMUTABLE_COLUMNS]

# --- fixed values: probability bands, age bands, sampling targets --------------------------
PROBABILITY_BANDS = (
    (0.3, "CLEAR_ACCEPT"),
    (0.45, "LEAN_ACCEPT"),
    (0.55, "BOUNDARY"),
    (0.7, "LEAN_REJECT"),
    (1.0, "CLEAR_REJECT"),
)
AGE_BANDS = ((36, "18-35"), (51, "36-50"), (66, "51-65"), (None, "65+"))
AGE_UNKNOWN = "Unknown"
SAMPLING_TARGETS = {
    "CLEAR_REJECT": 20,
    "LEAN_REJECT": 20,
    "BOUNDARY": 35,
    "LEAN_ACCEPT": 5,
    "CLEAR_ACCEPT": 5,
}
BAND_PRIORITY = ["BOUNDARY", "CLEAR_REJECT", "CLEAR_ACCEPT", "LEAN_REJECT", "LEAN_ACCEPT"]

# --- fixed values: terms that reveal an immutable feature ----------------------------------
# feature, terms in the order in which they are tried
IMMUTABLE_TERMS = (
    ("age", ("age", "years old", "older", "younger", "how old", "aging")),
    ("imputed_income", ("imputed_income", "imputed income")),
    ("NumberOfDependents", ("numberofdependents", "dependents", "children", "family size",
                            "number of dependents", "kids")),
)

# --- fixed values: rounding of a suggested target, direction and step ----------------------
TARGET_ROUNDING = {
    "income": ("up", 10.0),
    "debt_ratio": ("down", 0.01),
    "utilisation": ("down", 0.01),
    "open_lines": ("up", 1.0),
    "real_estate": ("up", 1.0),
    "late_30_59": ("down", 1.0),
    "late_60_89": ("down", 1.0),
    "late_90": ("down", 1.0),
}

# --- fixed values: shown values of changed features: least, greatest, whole number ----------
SHOWN = {
    "age": (18.0, 100.0, False),
    "income": (0.0, None, False),
    "debt_ratio": (0.0, None, False),
    "utilisation": (0.0, None, False),
    **{c: (0.0, None, True) for c in COUNT_COLUMNS},
}

# --- fixed values: spellings in suggestions, first match counts ----------------------------
NAME_PATTERNS = (
    (r"Days.*30[-_]59|30[-_]59.*Days", "NumberOfTime30-59DaysPastDueNotWorse"),
    (r"Days.*60[-_]89|60[-_]89.*Days", "NumberOfTime60-89DaysPastDueNotWorse"),
    (r"Days.*90|90.*Days", "NumberOfTimes90DaysLate"),
    (r"RealEstate|(?i:real estate)", "NumberRealEstateLoansOrLines"),
)
LOG_SUFFIX = "_log"

# --- fixed values: sentences in place of counterfactuals ------------------------------------
CF_SENTENCES = {
    "failed": "Counterfactual generation failed: ",
    "none": "No counterfactual scenarios available.",
    "first_broken": "First counterfactual contains an error.",
    "empty": "No valid counterfactual scenarios available.",
}

# --- fixed values: checklist items of the readability and actionability rubric -------------
CHECKLIST_ITEMS = (
    (1, "Makes purpose completely evident"),
    (2, "No distracting information"),
    (3, "Uses common, everyday language"),
    (4, "Financial terms defined when used"),
    (5, "Uses active voice"),
    (6, "Numbers clear and easy to understand"),
    (7, "No calculations expected from user"),
    (8, "Breaks information into short sections"),
    (9, "Sections have informative headers"),
    (10, "Presents information in logical sequence"),
    (11, "Provides summary"),
    (12, "Uses visual cues for key points"),
    (15, "Uses visual aids when helpful"),
    (16, "Visual aids reinforce content"),
    (17, "Visual aids have clear titles/captions"),
    (18, "Illustrations clear and uncluttered"),
    (19, "Simple tables with clear headings"),
    (20, "Clearly identifies at least one action"),
    (21, "Addresses user directly for actions"),
    (22, "Breaks actions into manageable steps"),
    (23, "Provides tangible tools when helpful"),
    (24, "Provides calculation instructions"),
    (25, "Explains how to use charts/graphs"),
    (26, "Uses visual aids for easier action"),
)
FIRST_ACTION_ITEM = 20

PAIR_CLASSES = ["same_instance", "intra_cluster", "inter_cluster", "random_baseline"]


@dataclass(frozen=True)
class Frozen:
    """Parameters fixed at training time: caps, fill-in income, scaling, linear model."""

    caps: dict = field(default_factory=lambda: {
        "utilisation": (0.0, 1.0929557681400022),
        "debt_ratio": (0.0, 2.4702802109800093),
        "income": (0.0, 23000.0),
    })
    median_income: float = 5400.0
    log_columns: tuple = ()
    dropped_columns: tuple = ("Unnamed: 0", "SeriousDlqin2yrs")
    center: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)
    intercept: float = 0.0


# --- record schemas ------------------------------------------------------------------------
APPLICANT_CSV = T.StructType([
    T.StructField("Unnamed: 0", T.LongType()),
    T.StructField("SeriousDlqin2yrs", T.IntegerType()),
    T.StructField("RevolvingUtilizationOfUnsecuredLines", T.DoubleType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("NumberOfTime30-59DaysPastDueNotWorse", T.DoubleType()),
    T.StructField("DebtRatio", T.DoubleType()),
    T.StructField("MonthlyIncome", T.StringType()),
    T.StructField("NumberOfOpenCreditLinesAndLoans", T.DoubleType()),
    T.StructField("NumberOfTimes90DaysLate", T.DoubleType()),
    T.StructField("NumberRealEstateLoansOrLines", T.DoubleType()),
    T.StructField("NumberOfTime60-89DaysPastDueNotWorse", T.DoubleType()),
    T.StructField("NumberOfDependents", T.DoubleType()),
])

CHANGE = "struct<`from`:double,`to`:double,diff:double,from_percentile:double,to_percentile:double,percentile_change:double>"
PREDICTION_RECORD = (
    "struct<prediction:struct<prediction_id:string,prediction:int,probability:double,"
    "input_data:map<string,double>,timestamp:string>,cluster_id:int,"
    "shap_explanation:struct<baseline:double,contributions:map<string,double>,model_probability:double,"
    "shap_sum_logit:double,shap_probability:double,difference:double,error:string>,"
    "counterfactuals:array<map<string,string>>>"
)
TOKEN_USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,total_cost:double>"
EXPLANATION_RECORD = (
    "struct<prediction_id:string,cluster_id:int,timestamp:string,regeneration_number:int,"
    "explanation_id:string,llm_name:string,explanation_text:string,processing_time:double,"
    f"token_usage:{TOKEN_USAGE},error:string,explanation_timestamp:string>"
)
RESPONSE_RECORD = "struct<consumer_explanation:string,analysis:struct<top_features:array<string>>>"
SCORE = "struct<score:string>"
JUDGE_RECORD = (
    "struct<cemat_evaluation:struct<understandability_items:map<string,string>,"
    "actionability_items:map<string,string>>,"
    f"regulatory_compliance:struct<principal_reason_identification:{SCORE},"
    f"individual_specific_content:{SCORE},technical_jargon_check:{SCORE}>,"
    "counterfactual_extraction:struct<changes:array<struct<feature_name:string,target_value:string>>>>"
)
#: Suggested changes in every stored shape: a list of targets, one from/to, or an older list of from/to.
SUGGESTION_SHAPES = (
    "struct<changes:array<struct<feature_name:string,target_value:string>>,feature_name:string,from_value:string,to_value:string,"
    "counterfactual_changes:array<struct<feature_name:string,from_value:string,to_value:string>>>"
)

"""Quality rules with adaptive limits, in DataFrame functions only.

Each text is measured on words, symbols, capitals, repeated lines and repeated word windows. Every measure is an integer
(thousandths of a share, tenths of a mean length), counted per language and source in a quantile sketch of fixed buckets:
counts of a bucket add up, so sketches of tasks, sources and languages merge exactly and the same rows always give the
same limits. A document is kept if it passes the base rules and none of its measures lies beyond the limits of its
(language, source) group. A group of fewer than MIN_ROWS documents takes the merged sketch of its language, and a language
of fewer the one of all rows. The limits are joined to the measures; texts are read once and never shuffled.

Defined cases: null and empty texts have no words and fail the base rules; null languages and sources are groups of their own;
repeated rows are judged alike; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from decision_lens.llm.textkit import fresh, quoted
from decision_lens.session import stage

SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_ROWS = 50
SPREAD = 4
MAX_LENGTH = 1000
#: Least distance between the median and the outer quartile that counts, by measure.
MEASURES = {"symbol_share": 10, "capital_share": 40, "dup_line_share": 50, "repeat_share": 50, "word_length": 6}
TWO_SIDED = ("word_length",)
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES, "base_failed", "kept", "failed_rules"]


def measured(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Base counts and measures of every whole text."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    t, w, h, r, wh, runs, at, capitals, n_lines = (fresh(keep + RESULTS, n) for n in (
        "body_", "words_", "hashes_", "lines_", "word_hashes_", "runs_", "places_", "capitals_", "n_lines_"))
    kept = [quoted(c) for c in keep]
    df = docs.select(*kept, F.coalesce(quoted(text).cast("string"), F.lit("")).alias(t))
    df = df.select(*kept, t, F.array_remove(F.split(t, SPACE + "+"), "").alias(w),
                   F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias(r))
    # Hash words one by one, then windows of hashes; windows whose 64-bit hashes agree count as equal.
    df = df.select(*kept, t, w, r, F.transform(w, lambda x: F.xxhash64(x)).alias(wh))
    df = df.select(*kept, t, w, r, F.expr(
        f"transform(sequence(0, size({wh}) - {WINDOW}, if(size({wh}) < {WINDOW}, -1, 1)), i -> "
        f"xxhash64({', '.join(f'try_element_at({wh}, i + {j + 1})' for j in range(WINDOW))}))").alias(h))
    df = df.select(*kept, t, w, r, F.when(F.size(w) >= WINDOW, F.col(h)).otherwise(F.expr("array()").cast("array<bigint>")).alias(h))
    sorted_windows = f"sort_array(transform({h}, (x, i) -> struct(x AS h, i AS i)))"
    df = df.select(*kept, t, w, r, F.expr(
        f"CASE WHEN size({h}) > size(array_distinct({h})) THEN {sorted_windows} END").alias(runs))
    df = df.select(*kept, t, w, r, F.expr(
        f"sort_array(transform(filter(sequence(1, size({runs})), k -> (k > 1 AND {runs}[k - 1].h = {runs}[k - 2].h) "
        f"OR (k < size({runs}) AND {runs}[k - 1].h = {runs}[k].h)), k -> {runs}[k - 1].i))").alias(at))
    df = df.select(
        *kept, F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))).cast("long").alias(capitals),
        F.size(r).cast("long").alias(n_lines), (F.size(r) - F.size(F.array_distinct(r))).cast("long").alias("n_dup_lines"),
        F.expr(f"coalesce({WINDOW} + aggregate(sequence(1, size({at}) - 1, if(size({at}) < 2, -1, 1)), 0L, (a, k) -> "
               f"a + if(size({at}) < 2, 0L, least({WINDOW}, {at}[k] - {at}[k - 1]))), 0L)").alias("n_repeat_words"))
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return df.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share(F.col("n_symbols"), chars).alias("symbol_share"), share(F.col(capitals), chars).alias("capital_share"),
        share(F.col("n_dup_lines"), F.greatest(n_lines, F.lit(1))).alias("dup_line_share"),
        share(F.col("n_repeat_words"), words).alias("repeat_share"),
        F.least(F.expr("10 * word_chars div greatest(n_words, 1)"), F.lit(MAX_LENGTH)).cast("long").alias("word_length"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))


def share(part: Column, whole: Column) -> Column:
    """Thousandths, rounded down."""
    return F.floor(1000 * part / whole).cast("long")


def sketches(measures: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang_, source_, measure, bucket, n): mergeable counts of documents that have words."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bucket")) for m in MEASURES]))
    return (measures.where("n_words > 0").select(quoted(lang).alias("lang_"), quoted(source).alias("source_"), long.alias("x"))
            .groupBy("lang_", "source_", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n")))


def quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, lower quartile, median and upper quartile of each merged sketch. A window holds one sketch, of 1001 buckets at most."""
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    at = Window.partitionBy(*keys, "measure")
    run = merged.withColumn("upto", F.sum("n").over(at.orderBy("bucket"))).withColumn("rows", F.sum("n").over(at))
    return run.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), *[
        F.min(F.when(4 * F.col("upto") >= q * F.col("rows"), F.col("bucket"))).alias(f"q{q}") for q in (1, 2, 3)])


def limits(counts: DataFrame) -> DataFrame:
    """Lower and upper limit of every measure for each (lang_, source_), from the narrowest sketch with enough rows."""
    own, by_lang, overall = quartiles(counts, ["lang_", "source_"]), quartiles(counts, ["lang_"]), quartiles(counts, [])
    o, l, a = own.alias("o"), by_lang.alias("l"), overall.alias("a")
    both = (o.join(l, (F.col("o.measure") == F.col("l.measure")) & F.col("o.lang_").eqNullSafe(F.col("l.lang_")))
            .join(a, F.col("o.measure") == F.col("a.measure")))
    pick = lambda q: F.when(F.col("o.rows") >= MIN_ROWS, F.col(f"o.{q}")).when(F.col("l.rows") >= MIN_ROWS, F.col(f"l.{q}")).otherwise(F.col(f"a.{q}"))
    least = F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv])[F.col("o.measure")]
    flat = both.select(F.col("o.lang_").alias("lang_"), F.col("o.source_").alias("source_"), F.col("o.measure").alias("measure"),
                       (pick("q2") + SPREAD * F.greatest(pick("q3") - pick("q2"), least)).alias("hi"),
                       (pick("q2") - SPREAD * F.greatest(pick("q2") - pick("q1"), least)).alias("lo"))
    ends = [(m, "hi") for m in MEASURES] + [(m, "lo") for m in TWO_SIDED]
    return flat.groupBy("lang_", "source_").agg(*[F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}_") for m, e in ends])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Documents with counts, measures, base_failed, kept and the rules that each one breaks."""
    carry = docs.columns if carry is None else carry
    rows, keys = packed(docs, text, lang, source, [c for c in carry if c not in RESULTS]), ("lang_of_row_", "source_of_row_")
    measures = stage(measured(rows, "body_of_row_", ["row_", *keys]))
    return verdicts(measures, limits(sketches(measures, *keys)), *keys).select("row_.*", *RESULTS)


def packed(docs: DataFrame, text: str, lang: str, source: str, carry: list[str]) -> DataFrame:
    """The columns to carry in one, out of the way of inner names, and the three that are read."""
    return docs.select(F.struct(*[quoted(c) for c in carry]).alias("row_"), quoted(text).alias("body_of_row_"),
                       quoted(lang).alias("lang_of_row_"), quoted(source).alias("source_of_row_"))


def verdicts(measures: DataFrame, bounds: DataFrame, lang: str, source: str) -> DataFrame:
    m = measures.join(bounds, quoted(lang).eqNullSafe(F.col("lang_")) & quoted(source).eqNullSafe(F.col("source_")), "left")
    rules = [(f"{x} high", F.col(x) > F.col(f"{x}_hi_")) for x in MEASURES] + [(f"{x} low", F.col(x) < F.col(f"{x}_lo_")) for x in TWO_SIDED]
    failed = F.array_compact(F.array(F.when(F.col("base_failed"), "base"), *[F.when(~F.col("base_failed") & c, n) for n, c in rules]))
    return m.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, with their own columns.

    Texts are measured twice, for the limits and for the verdicts, so that no copy of them is stored in between.
    """
    rows, keys = packed(docs, text, lang, source, docs.columns), ("lang_of_row_", "source_of_row_")
    bounds = stage(limits(sketches(measured(rows, "body_of_row_", list(keys)), *keys)))
    return verdicts(measured(rows, "body_of_row_", ["row_", *keys]), bounds, *keys).where("kept").select("row_.*")

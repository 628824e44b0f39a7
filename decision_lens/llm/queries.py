"""One query per operation, over whole tables, with SQL twins where SQL can state the result."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from decision_lens.llm import attention_lm, chat, chunk_dedup, decontaminate as decon, hard_negatives, pieces, posting_lists, quality_cnn, rules, suffix_dedup, superminhash, turn_repair, warc
from decision_lens.llm.sql import BLOCKS_SQL
from decision_lens.llm.textkit import importable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    if fn.__name__ in BLOCKS_SQL:
        ORACLES[fn.__name__] = BLOCKS_SQL[fn.__name__]
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), carry=["doc_id", "lang", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decon.scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(chat.turns_of(rows.unionByName(more))))


@query
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.with_originals(warc.read_archives(spark, folder, payload=False))


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_cnn.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return scores.select("doc_id", "held_out", "score", "predicted")


@query
def op10_superminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


@query
def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.deduplicated(table(spark, sf_dir, "documents"), carry=["doc_id"])
    spans = F.col("removed_spans")
    gone = F.aggregate(spans, F.struct(F.lit(-1).cast("long").alias("sign"), F.lit(0).cast("long").alias("sum")),
                       lambda s, x: F.struct((-s["sign"]).alias("sign"), (s["sum"] + s["sign"] * x).alias("sum")))["sum"]
    return out.select("doc_id", "n_chunks", (F.size(spans) / 2).cast("long").alias("n_spans"), gone.alias("n_removed"),
                      F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encoded(table(spark, sf_dir, "documents"), carry=["doc_id", "text"], decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query
def op7_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scored(table(spark, sf_dir, "documents"))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns = turn_repair.judged(turn_repair.damaged(rows))
    return turn_repair.digests(rows, turns, turn_repair.audits(turns))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query
def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.searched(table(spark, sf_dir, "embeddings"))

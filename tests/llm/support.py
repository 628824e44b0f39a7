"""Small frames with the odd cases that every operation must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text); lang and source follow the id."""
    return spark.createDataFrame([(i, t, None if i is None else "en" if i % 2 else "de", None if i is None else f"s{i % 3}",
                                   None if t is None else len(t)) for i, t in rows], DOCS)


LONG = words(99, 20_000)
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, words(5, 80)), (6, words(5, 80)), (6, words(5, 80)), (7, LONG), (8, "ß▁é 😀\r\n" * 30),
       (None, words(5, 80)), (9, words(9, 60) + " " + words(5, 80)), (10, "a" * 3000), (None, None)]


def odd(spark, **more):
    """ODD with columns whose names operations use themselves."""
    from pyspark.sql import functions as F
    df = documents(spark, ODD)
    for name in ["score", "n_words", "kept", "ids", "text_", "rest_", "hash", "block", "u", "key", "id", "id_", "repeats_", "gone_id_", "row_key_", "wh_", "word_hashes_", "lang_", "source_",
                 "capitals_", "s_", "p_", "row_", "part", "node"]:
        df = df.withColumn(name, F.lit("mine"))
    return df

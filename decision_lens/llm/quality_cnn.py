"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of KERNEL bytes, STRIDE apart, from its first byte to its last. Each byte has a learned
vector; learned filters run over every chunk; the greatest response of each filter over the whole text, cut off at 0, goes with
a learned weight into one probability. Training uses Adam on a bounded sample of labelled rows: SAMPLE rows of each class with
the smallest hash of their id, of texts up to SAMPLE_BYTES bytes, the same rows in every run. Scoring reads every byte.

Defined cases: null and empty texts are one chunk of padding; without labels, or with labels of one class only, every score is
0.5 or that class; rows with a null id are scored and never learned from; several labels of an id count as their greatest;
repeated rows get equal scores but for rounding; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from decision_lens.llm.textkit import map_texts, quoted

KERNEL, STRIDE, WIDTH, FILTERS = 16, 8, 6, 24
SAMPLE, SAMPLE_BYTES = 700, 20_000
EPOCHS, BATCH, RATE = 10, 32, 0.01
PAD = 256
PREDICT_AT = 0.3


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (257, WIDTH)), "filters": r.normal(0, 1 / np.sqrt(KERNEL * WIDTH), (KERNEL * WIDTH, FILTERS)),
                  "bias": np.zeros(FILTERS), "out": r.normal(0, 0.3, FILTERS), "base": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def layout(self, texts: list[bytes]):
        """Padded byte ids, and the first chunk and number of chunks of each text."""
        chunks = np.array([max(1, -(-(len(t) - KERNEL) // STRIDE) + 1) for t in texts])
        room = chunks + KERNEL // STRIDE - 1
        first = np.concatenate([[0], np.cumsum(room)[:-1]])
        ids = np.full(int(room.sum()) * STRIDE, PAD, dtype=np.int16)
        for t, f in zip(texts, first):
            ids[f * STRIDE:f * STRIDE + len(t)] = np.frombuffer(t, dtype=np.uint8)
        return ids, first, chunks

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Filter responses of all chunks. A chunk is two strides, so it is the sum of two half products."""
        halves = self.p["embed"][ids].reshape(-1, STRIDE * WIDTH)
        w = self.p["filters"]
        cut = STRIDE * WIDTH
        return halves[:-1] @ w[:cut] + halves[1:] @ w[cut:] + self.p["bias"]

    def pooled(self, texts: list[bytes]):
        ids, first, chunks = self.layout(texts)
        act = self.responses(ids)
        ends = np.stack([first, first + chunks], axis=1).ravel()
        ends[-1] = min(ends[-1], len(act))
        return ids, first, chunks, act, np.maximum.reduceat(act, ends[:-1] if ends[-1] >= len(act) else ends, axis=0)[::2]

    def score(self, texts: list[bytes]) -> np.ndarray:
        best = np.maximum(self.pooled(texts)[-1], 0)
        return 1 / (1 + np.exp(-(best @ self.p["out"] + self.p["base"]).astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict:
        ids, first, chunks, act, best = self.pooled(texts)
        place = np.stack([act[f:f + c].argmax(axis=0) + f for f, c in zip(first, chunks)])
        h = np.maximum(best, 0)
        d = (1 / (1 + np.exp(-(h @ self.p["out"] + self.p["base"]))) - y)[:, None] / len(y)
        grad = d * self.p["out"] * (best > 0)
        seen = ids[place[:, :, None] * STRIDE + np.arange(KERNEL)]
        vectors = self.p["embed"][seen].reshape(len(y), FILTERS, KERNEL * WIDTH)
        back = grad[:, :, None] * self.p["filters"].T
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, seen.ravel(), back.reshape(-1, WIDTH))
        return {"embed": embed, "filters": np.einsum("bf,bfk->kf", grad, vectors), "bias": grad.sum(0), "out": (h * d).sum(0), "base": d.sum(0)}


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 7):
    """A fitted network, or a constant when the rows hold fewer than two classes."""
    classes = {y for _, y in rows}
    if len(classes) < 2:
        return float(classes.pop()) if classes else 0.5
    net, rng = Network(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    y = np.array([r[1] for r in rows], dtype=np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            step += 1
            for k, g in net.gradients([rows[i][0] for i in pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, folds: int, sample: int = SAMPLE) -> list[tuple[bytes, int]]:
    """The bounded sample: of each class the rows with the smallest hash of their id, not from fold 0."""
    known = (labels.where(quoted(key).isNotNull() & quoted(label).isNotNull() & (fold(quoted(key), folds) != 0))
             .groupBy(quoted(key).alias("k")).agg(F.max(quoted(label)).alias("y")).withColumn("h", F.xxhash64("k")))
    picked = known.where("y = 0").orderBy("h", "k").limit(sample).unionAll(known.where("y <> 0").orderBy("h", "k").limit(sample))
    texts = docs.select(quoted(key).alias("k"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES)
    # picked holds 2 * sample rows at most
    rows = texts.join(F.broadcast(picked), "k").groupBy("k").agg(F.min("h").alias("h"), F.min("t").alias("t"), F.max("y").alias("y")).orderBy("h", "k").collect()
    return [(r["t"].encode(), int(r["y"] != 0)) for r in rows]


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5,
           carry: list[str] | None = None) -> DataFrame:
    """Documents with score (1 is good), predicted and held_out."""
    model = train(training_rows(docs, labels, key, text, label, folds))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        net = known.value
        return [np.full(len(texts), net) if isinstance(net, float) else net.score([t or b"" for t in texts])]

    keep = docs.columns if carry is None else carry
    out = map_texts(docs, text, [T.StructField("score", T.DoubleType())], score, keep=keep, limit=1 << 20)
    return (out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
            .withColumn("held_out", F.coalesce(fold(quoted(key), folds) == 0, F.lit(False))))

"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network whose loss is
the non-negative unbiased risk: pi * R_pos(+) + max(0, R_unl(-) - pi *
R_pos(-)), with the class prior pi estimated as the share of positives among
the labels that may be learned from.  Features are counts over whole texts.

Fitting takes about MAX_FIT positives and as many unlabelled texts, chosen by
a hash of the id (all where there are no more); every document is scored.

Defined results: null text counts as empty; an empty text is scored by its
features like any other; without positives every score is 0.5; a document
labelled twice counts by its greatest label; rows with equal ids are scored
each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, small_batches

MAX_FIT = 6000
HIDDEN, STEPS, RATE, DECAY = 16, 1000, 0.02, 1e-5
SEED = 7
#: Score from which a document counts as good.
THRESHOLD = 0.3

_MARKS = b"!#*$%&|.,<>/\\{}_=@:;?\"'()-\n\t"


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words = text.split()
    n = max(len(words), 1)
    upper, lower, digits = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    out = [min(1.0, raw[b] / n) ** 0.5 for b in _MARKS]
    out += [
        np.log1p(len(words)) / 5,
        upper / max(1, upper + lower),
        min(2.0, digits / n) ** 0.5,
        raw[128:].sum() / max(1, raw.sum()),
        min(3.0, (raw.sum() - raw[32] - raw[10]) / n / 6),
        len(set(words)) / n,
        len(set(words)) / n**0.75,
        (sum(map(eq, words, words[1:])) / n) ** 0.5,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        min(2.0, 20 * len(lines) / n) ** 0.5,
        float(text.rstrip().endswith((".", "!", "?", '"'))),
    ]
    return [float(x) for x in out]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> dict:
    """The network that the non-negative risk leads to, by Adam on all rows at once."""
    rng = np.random.default_rng(SEED)
    mean, std = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.05
    x = (np.concatenate([positive, unlabelled]) - mean) / std
    n_pos, n_unl = len(positive), len(unlabelled)
    w = {"a": rng.normal(0, 0.3, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    for step in range(1, steps + 1):
        h = np.tanh(x @ w["a"] + w["b"])
        p = _sigmoid(h @ w["c"] + w["d"])
        # log loss: slope of the loss as positive is p - 1, as negative p
        pos, unl = p[:n_pos], p[n_pos:]
        loss_neg = -np.log(np.clip(1 - p, 1e-9, 1))
        negative_risk = loss_neg[n_pos:].mean() - prior * loss_neg[:n_pos].mean()
        slope = np.empty_like(p)
        if negative_risk >= 0:
            slope[:n_pos] = prior * (pos - 1) / n_pos - prior * pos / n_pos
            slope[n_pos:] = unl / n_unl
        else:  # step back from the part that went below zero
            slope[:n_pos] = prior * pos / n_pos
            slope[n_pos:] = -unl / n_unl
        dh = slope[:, None] * w["c"] * (1 - h * h)
        grad = {"a": x.T @ dh + DECAY * w["a"], "b": dh.sum(axis=0), "c": h.T @ slope + DECAY * w["c"], "d": slope.sum(keepdims=True)}
        for k, g in grad.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"mean": mean, "std": std}


def apply(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    h = np.tanh((x - model["mean"]) / model["std"] @ model["a"] + model["b"])
    return _sigmoid(h @ model["c"] + model["d"])


def _featured(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        freed()
        for batch in batches:
            rows = [features(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["positive", "x"])

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> dict | None:
    """Learns from labels (doc_id, quality) and docs (doc_id, text); None without positives."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.sum(F.col("quality").cast("long"))).first()
    if not good:
        return None
    n_docs = docs.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    trusted = known.where("quality = 1").where(place < min(1.0, max_fit / good)).select("doc_id")
    other = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    web = docs.where(other < min(1.0, max_fit / max(n_docs, 1))).select(F.lit(False).alias("positive"), "text")
    rows = _featured(docs.join(trusted, "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text").unionAll(web)).collect()  # about twice max_fit rows of numbers
    positive = np.array([r["x"] for r in rows if r["positive"]])
    unlabelled = np.array([r["x"] for r in rows if not r["positive"]])
    if not len(positive) or not len(unlabelled):
        return None
    return train(positive, unlabelled, min(0.99, good / n))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        freed()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([features(s) for s in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(apply(shared.value, x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text reaches the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        freed()
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(s) for s in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(apply(shared.value, x) >= threshold))

    return docs.mapInArrow(run, docs.schema)

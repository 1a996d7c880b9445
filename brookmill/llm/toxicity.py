"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams.

Features are word unigrams, bigrams and skip-bigrams (one or two words left out), hashed to
2**bits coordinates; a feature counts once per document. Per-coordinate learning rates and the
L1 penalty leave few weights other than zero, so the model that goes to the workers is small.

Training takes a bounded sample of labelled rows (`sample_rows`, in the order of a hash of the
id), deals it to `shards` groups that train side by side, and averages their weights.

Nulls and edges: a null or empty text has no features and gets the score of the bias; rows with
null labels teach nothing; of several labels of one id the largest counts; repeated documents
are scored row by row; without any training row all scores are 0.5. Extra columns pass through
`score_toxicity` unless they carry the name of an output, which then replaces them.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, sample_of_labels

BITS, SHARDS, SAMPLE_ROWS, EPOCHS = 20, 2, 30_000, 4
ALPHA, BETA, L1, L2 = 4.0, 1.0, 8.0, 0.0
#: Bytes that end a word: ASCII punctuation and control characters become spaces.
_WORD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def hashed(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed features of one whole text, in the order of the text, repeats included."""
    words = (text or "").encode().lower().translate(_WORD).split()
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    parts = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:] + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and bias after `epochs` passes over the rows in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = zb = nb = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, float(-zb / ((beta + np.sqrt(nb)) / alpha))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", training: Column | None = None, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS, bits: int = BITS) -> dict:
    """A model from labelled documents: indices and values of its weights, bias, bits.

    `training` says which doc_id may teach. At most `sample_rows` labelled ids are used, and the
    weights that come back to the driver are 2**bits at most.
    """
    rows = sample_of_labels(docs, labels, label, training, sample_rows).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "doc_id"])
        weights, bias = ftrl([np.unique(hashed(t, bits)).astype(np.int32) for t in group.text], group.y.to_numpy(dtype=float), bits)
        give_back()
        at = np.flatnonzero(weights)
        return pd.DataFrame({"feature": np.append(at, -1), "weight": np.append(weights[at], bias)})

    fitted = rows.groupBy("shard").applyInPandas(fit, "feature long, weight double")
    summed = fitted.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).toPandas().sort_values("feature")
    bias = summed[summed.feature == -1]
    groups = int(bias.n.sum()) or 1
    rest = summed[summed.feature >= 0]
    return {"at": rest.feature.to_numpy(dtype=np.int64), "weights": rest.weight.to_numpy(dtype=float) / groups, "bias": float(bias.weight.sum()) / groups, "bits": bits}


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score double (0 to 1) and predicted int (1 from the threshold on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        weights = np.zeros(1 << m["bits"])
        weights[m["at"]] = m["weights"]
        known = weights != 0

        def one(t: str | None) -> float:
            codes = hashed(t, m["bits"])
            return weights[np.unique(codes[known[codes]])].sum() + m["bias"]

        for texts in batches:
            x = np.fromiter(map(one, texts), dtype=float, count=len(texts))
            give_back()
            yield pd.Series(1 / (1 + np.exp(-np.clip(x, -35, 35))))

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Text quality by Naive Bayes support vectors.

N-gram indicators (words as they stand, their shapes, pairs of either, and how often words
repeat one to three places on) are scaled by the log
ratio of how often their class holds them, and a linear model with hinge loss is fitted on top by
dual coordinate descent. A logistic curve over margins turns them into scores.

The fit takes a bounded sample of labelled rows (`sample_rows`, in the order of a hash of the id),
dealt to `shards` groups that are fitted side by side; the model is their mean. The curve is
fitted to margins of rows under the mean of the other shards' weights, so no row speaks for
weights that saw it.

Nulls and edges: a null or empty text has no features but the bias; rows with null labels teach
nothing; of several labels of one id the largest counts; repeated documents are scored row by
row; if nothing or only one class can be learned, every score is that class's share (0.5 without
rows). Extra columns pass through unless they carry the name of an output, which then replaces
them.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_of_labels

BITS, SHARDS, SAMPLE_ROWS, EPOCHS, COST, SMOOTH = 18, 4, 20_000, 10, 1.0, 1.0
_RUNS = [(re.compile(rb"[A-Z\xc3]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^Aa0\s])[^Aa0\s]*"), rb"\1")]


def hashed(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of one whole text, ascending."""
    raw = (text or "").encode()
    words = raw.split()
    shape = raw
    for run, mark in _RUNS:
        shape = run.sub(mark, shape)
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    s = np.fromiter(map(zlib.crc32, shape.split()), dtype=np.uint64, count=len(words)) ^ np.uint64(0x5A5A5A5A)
    again = [int(10 * (h[k:] == h[:-k]).sum() / len(h)) for k in (1, 2, 3) if len(h) > k]  # tenths of the words that stand k words before, too
    repeats = np.array([0xE9A1 + 256 * k + tenth for k, tenth in enumerate(again)], dtype=np.uint64)
    parts = [repeats, h, s, h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:], s[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + s[1:], np.array([0xB1A5 + min(len(words).bit_length(), 20)], dtype=np.uint64)]
    return np.unique((np.concatenate(parts) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64))


def nbsvm(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, cost: float = COST, smooth: float = SMOOTH) -> tuple[np.ndarray, float]:
    """Weights over indicators (the log ratios within) and bias."""
    up, down = np.full(1 << bits, smooth), np.full(1 << bits, smooth)
    for x, y in zip(rows, labels):
        (up if y > 0 else down)[x] += 1
    ratio = np.log(up / (labels > 0).sum()) - np.log(down / (labels <= 0).sum()) if 0 < (labels > 0).sum() < len(labels) else np.zeros(1 << bits)
    y = np.where(labels > 0, 1.0, -1.0)
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    norm = np.array([v @ v + 1 for v in values])
    up_share = (y > 0).mean() if len(y) else 0.5
    most = cost / np.where(y > 0, max(up_share, 1e-9), max(1 - up_share, 1e-9))  # both classes weigh alike
    w, bias, alpha = np.zeros(1 << bits), 0.0, np.zeros(len(y))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * ratio, float(bias)


def margin(x: np.ndarray, weights: np.ndarray, bias: float) -> float:
    return weights[x].sum() / np.sqrt(max(1, len(x))) + bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve 1 / (1 + exp(-(slope m + offset))), by Newton's method with a small penalty."""
    a, b = 1.0, 0.0
    scale = max(1e-9, float(np.abs(margins).mean()))
    m = margins / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g = np.array([((p - labels) * m).sum() + 0.01 * a, (p - labels).sum() + 0.01 * b])
        v = p * (1 - p)
        h = np.array([[(v * m * m).sum() + 0.01, (v * m).sum()], [(v * m).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", training: Column | None = None, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS, bits: int = BITS) -> dict:
    """A model from labelled documents. At most `sample_rows` margins and 2**bits weights for each shard reach the driver."""
    rows = sample_of_labels(docs, labels, label, training, sample_rows).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "doc_id"])
        weights, bias = nbsvm([hashed(t, bits) for t in group.text], group.y.to_numpy(), bits)
        at = np.flatnonzero(weights)
        return pd.DataFrame({"shard": group["shard"].iloc[0], "feature": [at], "weight": [weights[at]], "bias": bias, "rows": len(group), "up": group.y.sum()})

    fitted = rows.groupBy("shard").applyInPandas(fit, "shard int, feature array<long>, weight array<double>, bias double, rows long, up double").toPandas().sort_values("shard")
    count, up = int(fitted.rows.sum()), float(fitted.up.sum())
    if not 0 < up < count:
        return {"constant": up / count if count else 0.5}
    weights = np.zeros((len(fitted), 1 << bits))
    for row, (at, w) in enumerate(zip(fitted.feature, fitted.weight)):
        weights[row, at] = w
    biases = fitted.bias.to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((fitted["shard"].tolist(), weights.astype(np.float32), biases))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, w, b = sent.value
        for batch in batches:
            out = []
            for text, own in zip(batch.text, batch["shard"]):
                x = hashed(text, bits)
                others = [i for i, s in enumerate(numbers) if s != own] or [0]
                out.append(np.mean([margin(x, w[i], b[i]) for i in others]))
            yield pd.DataFrame({"margin": out, "y": batch.y})

    margins = rows.mapInPandas(judge, "margin double, y double").toPandas().sort_values(["margin", "y"])
    slope, offset = logistic(margins.margin.to_numpy(), margins.y.to_numpy())
    return {"weights": weights.mean(axis=0).astype(np.float32), "bias": float(biases.mean()), "slope": slope, "offset": offset, "bits": bits}


def score_quality(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score double (0 to 1) and predicted int (1 from the threshold on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = sent.value
        if "constant" in m:
            return pd.Series(np.full(len(texts), m["constant"]))
        x = np.fromiter((margin(hashed(t, m["bits"]), m["weights"], m["bias"]) for t in texts), dtype=float, count=len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(m["slope"] * x + m["offset"], -35, 35))))

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

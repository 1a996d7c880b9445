"""The learned operators against plain loops over the same rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brookmill.llm import decontamination, quality, queries, toxicity

from . import brute

SF = "/root/testdata/sf0.001"
MASK = 2**64 - 1


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def features(text: str | None) -> set:
    own = [zlib.crc32(w) for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())]
    one = [h * 0x9E3779B97F4A7C15 for h in own]
    two = [(own[i] * 0xC2B2AE3D27D4EB4F + own[i + gap] + gap) * 0x9E3779B97F4A7C15 for gap in (1, 2, 3) for i in range(len(own) - gap)]
    return {(x & MASK) >> 44 for x in one + two}


def test_op3_against_a_plain_learner(spark, docs):
    labels = pd.read_parquet(f"{SF}/labels.parquet").dropna(subset=["toxic"]).groupby("doc_id").toxic.max()
    placed = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.xxhash64("doc_id", F.lit("sample")).alias("at"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("shard")).distinct().toPandas()
    texts = docs.groupby("doc_id").text.min()
    shards = []
    for _, own in placed.sort_values(["at", "doc_id"]).groupby("shard"):
        rows = [(features(texts[d]), float(labels[d])) for d in own.doc_id if d in labels and d in texts and brute.fold(d, 4) != 2]
        z, n, bias = defaultdict(float), defaultdict(float), [0.0, 0.0]

        def weight(i, z=z, n=n):
            return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA)

        for _ in range(toxicity.EPOCHS):
            for x, y in rows:
                w = {i: weight(i) for i in x}
                b = -bias[0] / ((toxicity.BETA + math.sqrt(bias[1])) / toxicity.ALPHA)
                g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + b)))) - y
                for i in x:
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                    n[i] += g * g
                bias[0] += g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / toxicity.ALPHA * b
                bias[1] += g * g
        shards.append(({i: weight(i) for i in z}, -bias[0] / ((toxicity.BETA + math.sqrt(bias[1])) / toxicity.ALPHA)))
    got = queries.op3_toxicity(spark, SF).toPandas().set_index("doc_id").score
    for d, t in zip(docs.doc_id, docs.text):
        own = features(t)
        x = sum(sum(w.get(i, 0.0) for i in own) + b for w, b in shards) / len(shards)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, x)))), abs=1e-6)


def grams(text: str | None) -> Counter:
    out: Counter = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        s = f" {word} "
        out.update((c,) for c in word)
        out.update(tuple(s[i : i + 2]) for i in range(len(s) - 1))
        out.update(tuple(s[i : i + 3]) for i in range(len(s) - 2))
    return out


def ranked(counts: Counter, size: int = 300) -> list:
    return sorted(counts, key=lambda g: (-counts[g], tuple(map(ord, g)) + (0,) * (3 - len(g))))[:size]


def test_op4_against_a_plain_ranker(spark, docs):
    totals: dict = defaultdict(Counter)
    for d, t, lang in zip(docs.doc_id, docs.text, docs.lang):
        if t is not None and isinstance(lang, str) and brute.fold(d, 4) != 2:
            totals[lang].update(grams(t))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c))} for lang, c in sorted(totals.items())}
    got = queries.op4_language_id(spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        own = ranked(grams(t))
        if not own:
            assert (got.lang_pred[d], got.score[d]) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - r) if g in p else 300 for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert got.lang_pred[d] == best and got.score[d] == pytest.approx(1 - far[best] / (300 * len(own)))


def test_nbsvm_against_a_plain_descent():
    random = np.random.default_rng(14)
    rows = [np.unique(random.integers(0, 60, 12)) + (200 if k % 3 == 0 else 0) * (random.random(1) < 0.8) for k in range(90)]
    labels = np.array([float(k % 3 == 0) for k in range(90)])
    got, got_bias = quality.nbsvm(rows, labels, bits=9, epochs=4)
    up, down = Counter(), Counter()
    for x, y in zip(rows, labels):
        (up if y else down).update(x.tolist())
    ratio = {i: math.log((1 + up[i]) / sum(labels)) - math.log((1 + down[i]) / (90 - sum(labels))) for i in range(512)}
    values = [{i: ratio[i] / math.sqrt(len(x)) for i in x.tolist()} for x in rows]
    w, bias, alpha, order = defaultdict(float), 0.0, [0.0] * 90, np.random.default_rng(0)
    share = labels.mean()
    for _ in range(4):
        for i in order.permutation(90):
            y = 1.0 if labels[i] else -1.0
            g = y * (sum(w[k] * v for k, v in values[i].items()) + bias) - 1
            new = min(max(alpha[i] - g / (sum(v * v for v in values[i].values()) + 1), 0.0), 1 / (share if y > 0 else 1 - share))
            step, alpha[i] = (new - alpha[i]) * y, new
            bias += step
            for k, v in values[i].items():
                w[k] += step * v
    assert got_bias == pytest.approx(bias)
    assert np.allclose(got, [w[i] * ratio[i] for i in range(512)])
    wrong = sum((sum(got[x]) / math.sqrt(len(x)) + got_bias > 0) != (y > 0) for x, y in zip(rows, labels))
    assert wrong <= 9


def test_op5_both_ways(spark, docs):
    tokens = lambda t: re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", (t or "").lower())
    items = {i: tokens(t) for i, t in zip(*(pd.read_parquet(f"{SF}/benchmark.parquet")[c] for c in ("item_id", "text")))}
    runs = defaultdict(set)
    for i, own in items.items():
        for k in range(len(own) - 4):
            runs[tuple(own[k : k + 5])].add((i, k))
    longest, covered = defaultdict(int), defaultdict(set)
    for d, t in zip(docs.doc_id, docs.text):
        own, open_ = tokens(t), {}
        for p in range(len(own) - 4):
            here = {}
            for i, k in runs.get(tuple(own[p : p + 5]), ()):
                here[i, k] = open_.get((i, k - 1), 4) + 1
                longest[d, i] = max(longest[d, i], here[i, k])
                covered[d, i].update(range(k, k + 5))
            open_ = here
    found = {(r.doc_id, r.item_id): r.coverage for r in queries.op5_decontamination(spark, SF).collect()}
    assert {pair for pair, n in longest.items() if n >= 14} <= set(found)
    for (d, i), coverage in found.items():
        assert len(covered[d, i]) >= 0.45 * len(items[i]) or longest[d, i] >= 13, (d, i, coverage)
    assert len(found) > 2


def test_words_read_as_columns_are_those_read_one_by_one(monkeypatch):
    letters = [chr(c) for c in range(33, 0x250)] + ["İ", "ſ", "ŉ", "²", "½", "Ⅷ", "٣", "世", "»", "”", "́", "😀", "_", "\x1c"]
    words = [a + b for a in letters for b in ("", "x", "É.", "7", ",")] + [b + a for a in letters for b in ("x", "Ñ", '"(')]
    words += ["%", "%%%", "$5", "5$", "(two)", "Two", "Minutes,", "kg", "KG.", "don't", "_a_", "---", "x²", "3,14", "Straße", "ÀÉ!", "a×b", "÷"]
    words = sorted(set(words) - {w for w in words if any(c in " \t\n\x0b\x0c\r" for c in w)})
    n, kinds, caps, hashes = decontamination._read(pa.array(words))
    plain = [decontamination._parts(w) for w in words]
    assert n.tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    assert kinds.tolist() == [x[0] for x in flat] and caps.tolist() == [x[2] for x in flat]
    assert hashes.tolist() == [decontamination._hash(x[1]) for x in flat]

    read = []
    monkeypatch.setattr(decontamination, "_parts", lambda w: read.append(w) or [])
    decontamination.Tokens(['"Plain words, only: Ça va.', "année %%% x1"])
    assert sorted(read) == ["%%%", "x1"]

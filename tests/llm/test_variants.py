"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from brookmill.llm import queries, variants

from . import brute

SF = "/root/testdata/sf0.001"


def one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def counted(rows, slips: int | None = None, length: int = 6, least: int = 5) -> dict[str, int]:
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = brute.lower_ascii(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= least}


def wanted(n: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    near: dict[str, list] = {w: [] for w in n}
    holed: dict[str, set] = {}
    for w in n:  # words near each other share a word of one of them with a hole or a character left out
        for i in range(len(w)):
            holed.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
            holed.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        holed.setdefault(w, set()).add(w)
    for group in holed.values():
        for a, b in itertools.combinations(group, 2):
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in n:
        best = min(set(near[w]), key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(set(near[w])), n[form[w]] if form[w] else None) for w in n}


def rows(made) -> dict[str, tuple]:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in made.collect()}


def test_op11_against_all_words(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = queries.op11_spelling_variants(spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    made = rows(got)
    assert made == wanted(counted(zip(docs.doc_id, docs.text), 199)) and any(r[0] for r in made.values())


@pytest.mark.parametrize("most_pairs", [0, 3, 100, 10**9])
def test_hot_segments_lose_no_pair(spark, most_pairs):
    pick = random.Random(5)
    words = {"common" + "".join(pick.choices("abé", k=pick.randint(0, 7))) + pick.choice(["", "ending"]) for _ in range(400)}
    n = {w: pick.choice([5, 6, 30, 200, 5000]) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = variants.near_words(df, most_pairs).collect()
    pairs = {(r.word, r.near) for r in got}
    assert len(pairs) == len(got)
    assert pairs == {(a, b) for a in n for b in n if one_edit(a, b)}
    if most_pairs == 3:
        assert rows(variants.spelling_variants(df, most_pairs=most_pairs)) == wanted(n)


def test_chains_and_ties(spark):
    n = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 3125, "xbcdef": 25, "abcdex": 24, "lonely": 7}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    made = rows(variants.spelling_variants(df))
    assert made == wanted(n)
    assert made["abcdef"] == ("abcdefg", "abcdefghi", 5, 3, 25) and made["lonely"] == (None, "lonely", 7, 0, None)


def test_edges(spark):
    text = "Étude étude STRASSE strasse straße×÷ naïveté a1bcdefg " * 3
    given = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "x" * 100_000), (5, "wordly " * 30_000)]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    for slips in (None, 1, 7):
        made = {r.word: r.n for r in variants.count_words(docs, slips_every=slips).collect()}
        assert made == counted(given, slips)
    assert made and variants.spelling_variants(variants.count_words(docs.limit(0))).count() == 0
    assert variants.spelling_variants(variants.count_words(docs)).count() == len(counted(given))

"""Cross-tokenizer alignment against byte ranges compared one by one."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brookmill.llm import alignment, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spelled_a() -> dict[int, bytes]:
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    of, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            of[chr(256 + extra)], extra = b, extra + 1
    return {i: bytes(of.get(c, 63) for c in t) for t, i in Tokenizer.from_file(A).get_vocab().items()}


def plain(texts: list) -> list[tuple]:
    own, of_a = Tokenizer.from_file(A), spelled_a()
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)

    def of_b(i: int) -> bytes:
        p = model.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    def ranges(spelled: list[bytes]) -> list[tuple[int, int]]:
        ends = [sum(map(len, spelled[: k + 1])) for k in range(len(spelled))]
        return list(zip([0, *ends], ends))

    docs = []
    for t in texts:
        a, b = (own.encode(" " + t, add_special_tokens=False).ids, model.encode(t)) if t else ([], [])
        x, y = [of_a[i] for i in a], [of_b(i) for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append(([], [], [], []))
            continue
        ra, rb = ranges(x), ranges(y)
        links = [(a[i], b[j]) for i, p in enumerate(ra) for j, q in enumerate(rb) if max(p[0], q[0]) < min(p[1], q[1])]
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in ra} & {e for _, e in rb}):
            i2, j2 = sum(e <= cut for _, e in ra), sum(e <= cut for _, e in rb)
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        docs.append((a, b, groups, links))
    n = Counter(pair for d in docs for pair in set(d[3]))
    best: dict = {}
    for (a, _), c in n.items():
        best[a] = max(best.get(a, 0), c)
    out = []
    for a, b, groups, links in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(n[x] == best[x[0]] for x in links), sum(n[x] for x in links), sha))
    return out


def rows(made) -> list[tuple]:
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in made.collect())


TEXTS = ["Good morning to you", None, "", "naïve 日本語 😀 tail  ", "a ▁ literal", "<|endoftext|> and <s> here", "Good morning to you", " \n\tx\n\n y", "it's 12345 o'clock—now", "Zwölf Boxkämpfer jagen Viktor", "ends in a space ", " ", "\n ", "a\u00a0 b \u2003c\x1c d\u0085 e"]


@pytest.mark.parametrize("most_pairs", [0, 5, 10**6])
def test_small_texts(spark, most_pairs):
    given = [*enumerate(TEXTS), (None, TEXTS[0])]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS a_ids", "3 AS made", "4 AS pair")
    made = rows(alignment.align(docs, A, B, most_pairs=most_pairs))
    assert made == sorted((-1 if k is None else k, *x) for (k, _), x in zip(given, plain([t for _, t in given])))


def test_op12_against_plain(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    docs["short"] = docs.text.str.slice(0, 1500)  # the plain version is quadratic
    docs = docs.astype(object).where(docs.notna(), None)
    made = rows(alignment.align(spark.createDataFrame(docs[["doc_id", "short"]].values.tolist(), "doc_id long, short string"), A, B, text="short"))
    assert made == sorted((k, *x) for k, x in zip(docs.doc_id, plain(docs.short.tolist())))


def test_op12_whole_texts(spark):
    got = queries.op12_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    made = got.toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    own, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    own.encode_special_tokens = True
    for k, t in docs.text.items():
        if made.n_a[k]:
            assert (made.n_a[k], made.n_b[k]) == (len(own.encode(" " + t).ids), len(model.encode(t)))
        else:
            assert made.loc[k].tolist() == [0, 0, 0, 0, 0, 0, ""]
    assert (made.n_links == made.n_a + made.n_b - made.n_groups).all() and made.n_a.gt(0).mean() > 0.9


def test_long_and_none(spark):
    docs = spark.createDataFrame([(1, "The old river runs past seven quiet mills. " * 8000)], "doc_id long, text string")
    r = alignment.align(docs, A, B).first()
    assert r.n_links == r.n_a + r.n_b - r.n_groups == r.count_sum == r.n_best
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_ids_of_the_fast_encoder(spark):
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    fast, spelled = alignment.byte_level(A)
    texts = [t for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna()]
    for t in [*texts, *filter(None, TEXTS), "a" * 5000]:
        ids = own.encode(" " + t, add_special_tokens=False).ids
        assert fast(" " + t) == ids and b"".join(spelled[i] for i in ids) == (" " + t).encode()


def test_units_have_the_tokens_of_whole_texts():
    own, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    own.encode_special_tokens = True
    of_pieces = alignment.pieces(B)[0]
    for t in [*pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna(), *filter(None, TEXTS)]:
        if t:
            units = alignment._units(t, True)
            assert " ".join(units) == t
            assert [i for u in units for i in alignment.byte_level(A)[0](" " + u)] == own.encode(" " + t, add_special_tokens=False).ids
            assert [i for ids in of_pieces(units) for i in ids] == model.encode(t)


def test_units_are_aligned_at_once():
    sizes = np.array([1, 2, 3, 5])
    a, b = [[0, 1, 2], [], [3], [2, 2]], [[2, 0, 1], [], [1, 2], [2, 2]]
    made = alignment._aligned(a, b, sizes, sizes).to_pylist()
    assert [[divmod(x, 1 << 32) for x in r["links"]] for r in made] == [[(0, 2), (1, 2), (2, 0), (2, 1)], [], [(3, 1), (3, 2)], [(2, 2), (2, 2)]]
    assert [r["groups"] for r in made] == ["0,1|2;2|0,1", "", "3|1,2", "2|2;2|2"]
    assert alignment._aligned([], [], sizes, sizes).to_pylist() == []


def test_a_unit_costs_spark_no_interpreted_expression(spark):
    """Only the lists of documents and what they are put together from are walked by higher-order functions."""
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    calls = []

    def counted(name):
        of = getattr(F, name)
        return lambda *a, **b: (calls.append(name), of(*a, **b))[1]

    with pytest.MonkeyPatch.context() as patch:
        for name in ("transform", "zip_with", "aggregate", "array_union", "array_intersect"):
            patch.setattr(F, name, counted(name))
        alignment.align(docs, A, B)
    assert calls.count("transform") <= 5 and set(calls) == {"transform"}, calls

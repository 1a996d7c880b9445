"""The registered queries against plain versions, round trips and held-out accuracy."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brookmill.llm import queries
from tests import oracle

from . import brute

SF = "/root/testdata/sf0.001"
#: Enough labels to hold some out.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def test_op1_finds_the_nearest(spark):
    data = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(data.embedding).astype(float)
    ids = data.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = queries.op1_nearest_neighbours(spark, SF).toPandas()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        own = np.flatnonzero(ids == q)[0]
        score = x @ x[own]
        score[own] = -9
        wanted = np.lexsort((ids, -score))[:5]
        found = got[got.query_id == q].sort_values("rank")
        assert found["rank"].tolist() == [1, 2, 3, 4, 5]
        assert found.score.is_monotonic_decreasing
        assert np.allclose(found.score, [score[np.flatnonzero(ids == i)[0]] for i in found.vec_id])
        hits += len(set(found.vec_id) & set(ids[wanted]))
        total += 5
    assert hits >= 0.9 * total


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    made = queries.QUERIES[name](spark, SF).toPandas()
    wanted = oracle.connect(SF).execute(queries.ORACLE_SQL[name]).df()
    assert oracle.rows_of(made) == oracle.rows_of(wanted)


def rank_quality(y: pd.Series, score: pd.Series) -> float:
    ranks, up = score.rank(), (y == 1)
    return (ranks[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())


@pytest.mark.parametrize(("query", "label", "parts", "rest"), [(queries.op3_toxicity, "toxic", 4, 2), (queries.op6_quality, "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, query, label, parts, rest):
    got = query(spark, LARGER).toPandas()
    documents = pd.read_parquet(f"{LARGER}/documents.parquet")
    assert sorted(got.doc_id) == sorted(documents.doc_id)
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [brute.fold(i, parts) == rest for i in got.doc_id]).all()
    labels = pd.read_parquet(f"{LARGER}/labels.parquet").groupby("doc_id")[label].max().dropna()
    held = got[got.held_out].set_index("doc_id").join(labels, how="inner")
    assert rank_quality(held[label], held.score) > 0.85


def test_op4_on_held_out_rows(spark):
    got = queries.op4_language_id(spark, LARGER).toPandas().set_index("doc_id")
    documents = pd.read_parquet(f"{LARGER}/documents.parquet").drop_duplicates("doc_id").set_index("doc_id")
    held = got[got.held_out & (got.lang_pred != "und")].join(documents[["lang"]]).dropna()
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_op5_finds_every_whole_item(spark, docs):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    found = queries.op5_decontamination(spark, SF).toPandas()
    squeezed = {d: " ".join(brute.words(t)) for d, t in zip(docs.doc_id, docs.text)}
    wanted = {(d, i) for d, t in squeezed.items() for i, text in zip(items.item_id, items.text) if len(brute.words(text)) >= 8 and " ".join(brute.words(text)) in t}
    assert wanted and wanted <= set(zip(found.doc_id, found.item_id))


def test_op7_counts_and_base(spark, docs):
    texts = dict(zip(docs.doc_id, docs.text))
    wanted = brute.base_scores(texts, {d for d in texts if brute.fold(d, 5) != 1})
    got = queries.op7_language_model(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == wanted[r.doc_id][:3]
        assert r.base_score == pytest.approx(wanted[r.doc_id][3], rel=1e-9)
        assert r.held_out == (brute.fold(r.doc_id, 5) == 1)
    assert (got.score > got.base_score)[~got.held_out].all()
    assert got.score[got.held_out].sum() > got.base_score[got.held_out].sum()


def test_op8_gives_the_ids_of_whole_texts(spark, docs):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = queries.op8_token_files(spark, SF).toPandas().sort_values("start"), 0
    for r, (_, d) in zip(got.itertuples(), docs.sort_values("doc_id").iterrows()):
        ids = np.array([*own.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_op9_against_all_pairs(spark, docs):
    prints = {d: brute.fingerprint(t) for d, t in zip(docs.doc_id, docs.text)}
    as_int = {d: int(p, 16) for d, p in prints.items()}
    wanted = brute.groups(sorted(prints), lambda a, b: (as_int[a] ^ as_int[b]).bit_count() <= 3)
    got = queries.op9_simhash(spark, SF).toPandas()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {d: (prints[d], wanted[d]) for d in prints}


def test_op10_decodes_and_varies(spark, docs):
    got = queries.op10_pieces(spark, SF).toPandas().set_index("doc_id")
    assert got.lossless.all() and len(got) == len(docs)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {d: model.encode(t or "") for d, t in zip(docs.doc_id, docs.text)}
    assert sum(got.n_tokens) > 1.05 * sum(map(len, plain.values()))

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from brookmill.llm import ann, decontamination, langid, lm, pieces, quality, simhash, tokenfiles, toxicity, urls, vamana, wavelet
from brookmill.llm.bktree import Forest, hamming
from brookmill.llm.components import components

from . import brute

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "The old river runs past seven quiet mills and one loud town. " * 4000
ROWS = [(1, "Good morning to you all", "en"), (2, None, None), (3, "", "en"), (4, LONG, "en"), (4, LONG, "en"), (None, "no id here", None), (5, "\t\n ", "en"), (6, "123 %% 😀", "en")]
SCHEMA = "doc_id long, text string, lang string"
#: Columns that carry the names of outputs and of what operators use within.
CLASHING = ("score", "predicted", "lang_pred", "found", "leaks", "row", "_digest", "_key", "fingerprint", "ids", "decoded", "host", "rule", "_place", "_best", "shard")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def wide(edge):
    return edge.select("*", *[F.lit("own").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, None, None), (None, 1, 1), (3, None, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")


def test_nearest_edges(spark):
    v = [[1.0, 0.0], [1.0, 0.1], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, None], [], [1.0, 0.0], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([*enumerate(v), (1, [1.0, 0.1]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    got = ann.nearest(df, F.col("id") % 2 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 8), (0, 2, 1), (8, 1, 0), (8, 2, 1)]
    assert got[0].score == pytest.approx(1.0)
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def exact_nearest(x: np.ndarray, q: int, k: int = 5) -> list[int]:
    y = x / np.abs(x).max(axis=1, keepdims=True)
    score = (y @ y[q]) / (np.linalg.norm(y, axis=1) * np.linalg.norm(y[q]))
    score[q] = -2
    return np.lexsort((np.arange(len(x)), -score))[:k].tolist()


def test_nearest_of_equal_directions(spark):
    df = spark.createDataFrame([(i, [2.0**i, 0.0]) for i in range(60)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") == 50).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and all(r.score == 1.0 for r in got)


def test_nearest_among_near_copies_and_huge_components(spark):
    random = np.random.default_rng(8)
    base = random.normal(size=16)
    x = base + 1e-4 * random.normal(size=(400, 16))
    x[::7] *= 1e200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 40 == 0, shard_rows=150).orderBy("query_id", "rank").toPandas()
    assert {q: g.vec_id.tolist() for q, g in got.groupby("query_id")} == {q: exact_nearest(x, q) for q in range(0, 400, 40)}


def test_nearest_over_shards_and_graph_degree(spark):
    x = np.random.default_rng(3).normal(size=(900, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("id") % 30 == 0, shard_rows=200).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = {q: set(np.argsort(-(unit @ unit[q]))[1:6]) for q in range(0, 900, 30)}
    assert sum(len(wanted[q] & set(g.vec_id)) for q, g in got.groupby("query_id")) >= 0.9 * 150
    graph, _ = vamana.build(unit)
    assert graph.shape[1] == vamana.DEGREE and (graph < 900).all()


def test_each_node_is_searched_for_once_and_shards_grow(monkeypatch):
    x = np.random.default_rng(4).normal(size=(1500, 24)).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked, search = [], vamana.search
    monkeypatch.setattr(vamana, "search", lambda *a: asked.append(len(a[3])) or search(*a))
    graph, entries = vamana.build(unit)
    assert sum(asked) <= 1500
    found = search(unit, graph, entries, unit[:100], 96)[0][:, 1:6]
    wanted = np.argsort(-(unit[:100] @ unit.T), axis=1)[:, 1:6]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, wanted)]) >= 0.95 * 5
    # searches, queries times shards: six times the rows make at most twice the shards
    assert [ann.shards_of(n) for n in (0, 5_000, 5_001, 102_564, 615_384)] == [1, 1, 2, 21, 31]


def test_small_groups_of_near_copies_are_reached():
    random = np.random.default_rng(5)
    x, start = random.normal(size=(6000, 64)), 0
    for n in [600] + [20] * 100:
        x[start : start + n] = random.normal(size=64) + 0.05 * random.normal(size=(n, 64))
        start += n
    order = random.permutation(6000)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True))[order].astype(np.float32)
    asked = unit[(order >= 600) & (order < start)]
    graph, entries = vamana.build(unit)
    found = vamana.search(unit, graph, entries, asked, 96)[0][:, :5]
    wanted = np.argsort(-(asked @ unit.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, wanted)]) >= 0.995 * 5


def test_nearest_of_repeated_ids_and_null_components(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, None]), (4, [-1.0, 0.5]), (5, [float("-inf"), 1.0]), (6, [0.0, -0.0])]
    for kind in ("float", "double", "decimal(9,1)"):
        df = spark.createDataFrame([(str(i), v) for i, v in rows if i != 5 or kind != "decimal(9,1)"], "vec_id string, embedding array<double>")
        got = ann.nearest(df.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")), F.col("id") == "1").orderBy("rank").collect()
        assert [(r.query_id, r.vec_id) for r in got] == [("1", "2"), ("1", "4")] and got[0].score == 1.0


def test_url_edges_and_joined_index(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.ORG/es/x?q"), (5, "http://org#f"), (6, "x://notexample.org/es/"), (7, "http://a.b.com/de/" + "y" * 100_000), (8, "http://cheap-pills.net/"), (8, "http://cheap-pills.net/"), (9, "http://example.org?x/es/"), (10, "http://b.net/Free-Trial/x"), (11, "http://b.net/free/x/trial")]
    df = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("own").alias(c) for c in CLASHING])
    rules = [urls.prefix_rule(*r) for r in queries_rules()] + list(urls.PATTERNS)
    one = urls.judge_urls(df, rules)
    two = urls.judge_urls(df, rules, inline_rules=0)
    key = lambda d: sorted((r.page_id, r.host, r.path[:9], r.rule or "", r.verdict, r._place, r.row) for r in d.collect())
    assert key(one) == key(two)
    got = {r.page_id: (r.host, r.path[:4], r.rule, r.verdict) for r in one.collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/es/", "example.org/es/", "block") and got[5] == ("org", "", None, "allow")
    assert got[6][2] == "org/" and got[7][2:] == ("com/de/", "block") and got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "allow")
    assert one.count() == len(rows) and urls.judge_urls(df.limit(0), rules).count() == 0


def queries_rules():
    from brookmill.llm.queries import URL_RULES

    return URL_RULES


def test_toxicity_edges(wide, none, labels):
    model = toxicity.train(wide, labels, "toxic")
    got = toxicity.score_toxicity(wide, model)
    assert got.count() == len(ROWS) and got.where("row = 'own' and score between 0 and 1").count() == len(ROWS)
    assert got.where("doc_id in (2, 3, 5)").select("score").distinct().count() == 1
    assert {r.score for r in toxicity.score_toxicity(wide, toxicity.train(none, labels, "toxic")).collect()} == {0.5}
    assert toxicity.score_toxicity(none, model).count() == 0


def test_ftrl_learns_sparse_weights():
    random = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in random.integers(0, 300, 40)) + (" vile" if k % 3 == 0 else "") for k in range(300)]
    y = np.array([float(k % 3 == 0) for k in range(300)])
    w, bias = toxicity.ftrl([np.unique(toxicity.hashed(t)) for t in texts], y)
    score = [w[np.unique(toxicity.hashed(t))].sum() + bias for t in texts]
    assert min(s for s, v in zip(score, y) if v) > max(s for s, v in zip(score, y) if not v)
    assert 0 < np.count_nonzero(w) < 200


def test_quality_edges(wide, none, labels):
    model = quality.train(wide, labels, "quality")
    got = quality.score_quality(wide, model)
    assert got.count() == len(ROWS) and got.where("row = 'own' and score between 0 and 1").count() == len(ROWS)
    assert {r.score for r in quality.score_quality(wide, quality.train(none, labels, "quality")).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(wide, quality.train(wide, labels.where("quality = 1"), "quality")).collect()} == {1.0}
    assert quality.score_quality(none, model).count() == 0


def test_language_edges(wide, none):
    model = langid.profiles(wide)
    got = langid.identify(wide, model)
    assert got.count() == len(ROWS) and got.where("found = 'own'").count() == len(ROWS)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert by[2] == by[3] == by[5] == by[6] == ("und", 0.0) and by[4][0] == "en"
    assert {r.lang_pred for r in langid.identify(wide, langid.profiles(none)).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_language_pieces_count_as_whole(monkeypatch):
    whole = langid.counted(LONG)
    monkeypatch.setattr(langid, "PIECE", 1000)
    cut = langid.counted(LONG)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_leak_edges(spark, wide, none):
    items = spark.createDataFrame([(1, "If Anna Lee buys 7 kg of apples for 3 dollars and sells 7 kg later, what does Anna Lee earn in 2 days?"), (2, None), (3, ""), (4, "the old river runs past seven quiet mills and one loud town"), (4, "the old river runs past seven quiet mills and one loud town")], "item_id long, text string")
    got = decontamination.with_leaks(wide, items)
    assert got.count() == len(ROWS) and got.where("row = 'own'").count() == len(ROWS)
    assert {r.doc_id for r in decontamination.find_leaks(wide, items).collect()} == {4}
    kept = decontamination.drop_leaks(wide, items)
    assert kept.columns == wide.columns and kept.count() == len(ROWS) - 2 and kept.where("leaks = 'own'").count() == kept.count()
    assert decontamination.drop_leaks(none, items).count() == 0 and decontamination.drop_leaks(wide, items.limit(0)).count() == len(ROWS)
    told = [(1, "Here: If Bob Kay buys 9 kg of apples for 4 dollars and sells 9 kg later, what does Bob Kay earn in 5 days?"), (2, "Here: If Bob Kay buys 9 kg of apples for 4 dollars and sells 8 kg later, what does Tom Poe earn in 5 days?"), (3, "they buy apples and sell them later")]
    found = {r.doc_id: r for r in decontamination.find_leaks(spark.createDataFrame(told, "doc_id long, text string"), items).collect()}
    assert not found[1].verbatim and found[1].coverage == 1.0 and 3 not in found
    assert 2 not in found or found[2].coverage < 1.0
    blocks = decontamination.find_leaks(wide, items, block_tokens=5)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == {(4, 4)}


def test_leaks_of_items_full_of_numbers(spark):
    sum_of, mean = "What is 12 + 45 * 3 - 18 / 6 + 77 - 4 * 9 + 31 ?", "Compute the mean of 12, 15, 18, 21, 24, 27, 30, 33, 36, 39, 42, 45, 48 and 51"
    items = spark.createDataFrame([(1, sum_of), (2, mean)], "item_id long, text string")
    told = [(1, f"here we ask {sum_of} and go on"), (2, f"so then {mean} is the task"), (3, "to begin with we compute the mean of 3 values and leave the rest to others"), (4, "What is 2 + 3 ?")]
    got = decontamination.find_leaks(spark.createDataFrame(told, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2)} and all(r.verbatim and r.coverage == 1.0 for r in got)


def test_leaks_of_changed_and_cut_items(spark):
    random, items, told = np.random.default_rng(31), [], []
    for size, at in ((15, (7,)), (18, (9,)), (22, (11,)), (38, (12, 25)), (45, (11, 22, 33))):
        own = ["".join(random.choice(list("abcdefgh"), 7)) for _ in range(size)]
        changed = [*own]
        for k in at:
            changed[k] = "changed"
        items.append((size, " ".join(own)))
        told.append((size, " ".join(["before", *changed, "after"])))
    own = ["".join(random.choice(list("abcdefgh"), 7)) for _ in range(59)]
    items.append((59, " ".join(own)))
    told += [(59, " ".join(["before", *own[10:42], "after"])), (60, " ".join(["before", *own[20:33], "after"])), (61, " ".join(["before", *own[20:32], "after"])), (62, " ".join([*own[20:25], "before", *own[3:8]]))]
    got = decontamination.find_leaks(spark.createDataFrame(told, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in (15, 18, 22, 38, 45, 59)} | {(60, 59)}


def test_language_model_edges(wide, none):
    got = lm.score(wide, lm.train(wide)).toPandas()
    assert len(got) == len(ROWS) and np.isfinite(got.score).all() and (got.score <= 0).all()
    assert got[got.doc_id.isin([2, 3, 5])].n_tokens.tolist() == [1, 1, 1]
    assert lm.score(none, lm.train(none)).count() == 0
    untaught = lm.score(wide, lm.train(none)).toPandas()
    assert (untaught.train_tokens == 0).all() and np.allclose(untaught.base_score, 0.0)


def test_language_model_against_exact_counts(spark):
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{int(i)}" for i in random.geometric(0.05, 60)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lm.score(df, lm.train(df)).toPandas().sort_values("doc_id").score.to_numpy()
    wanted = np.array(brute.interpolated_scores(texts))
    # a count is known to its power of two only, which is at most a factor of 1.5
    assert np.abs(got - wanted).max() < 61 * math.log10(1.5) and np.abs(got - wanted).mean() / 61 < 0.05


def test_language_model_keeps_all_bigrams_past_the_bound(spark):
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{int(i)}" for i in random.geometric(0.05, 60)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = []
    for most in (1 << 20, 2000):
        model = lm.train(df, max_filter_bytes=most, chunk_chars=1000)
        scores.append((len(model.filters), lm.score(df, model, chunk_chars=4000).toPandas().sort_values("doc_id").score.to_numpy()))
    assert scores[0][0] == 1 and scores[1][0] > 2 and np.allclose(scores[0][1], scores[1][1], rtol=0, atol=1e-9)


def test_chances_of_a_context_sum_to_one():
    random = np.random.default_rng(9)
    vocabulary, n = random.integers(1, 2**63, 400, dtype=np.uint64), np.array([4] * 8 + [1, 2, 3, 900])
    context = np.full(len(n), 77, dtype=np.uint64)
    follower = vocabulary[: len(n)].astype(np.uint32)
    data = np.frombuffer(lm.segment(lm.key_of(context, follower), n, lm.BITS), dtype=np.uint8)
    f = lm.Filter(data, np.array([0]), np.array([len(data) * 8]))
    found = f.count(np.full(400, 77, dtype=np.uint64), vocabulary.astype(np.uint32))
    alone = random.random(400)
    alone *= 0.99 / alone.sum()  # the rest is the unknown's
    mass = lm.middle_of(lm.level_of(n)).sum()
    total = lm.chance(found, mass, np.int64(len(n)), alone).sum() + lm.chance(0.0, mass, np.int64(len(n)), 0.01)
    assert 1 - 1e-9 <= total <= 1 + (found[len(n) :].sum() + abs(found[: len(n)].sum() - mass)) / mass + 1e-9
    assert (found[len(n) :] > 0).mean() < 0.02


def test_filter_holds_what_it_was_given():
    context, follower = np.arange(1, 3001, dtype=np.uint64), np.arange(3000, dtype=np.uint32)
    n = np.arange(3000) % 9 + 1
    data = np.frombuffer(lm.segment(lm.key_of(context, follower), n, lm.BITS), dtype=np.uint8)
    f = lm.Filter(data, np.array([0]), np.array([len(data) * 8]))
    got = f.count(context, follower)
    low = 2.0 ** np.floor(np.log2(n))
    assert (got >= low).all() and (got == (low + 2 * low - 1) / 2).mean() > 0.97
    assert (f.count(context + np.uint64(10**6), follower) > 0).mean() < 0.02


def test_token_file_edges(spark, wide, none, tmp_path):
    tokenfiles.write_tokens(wide, str(tmp_path / "a"), WORDS, shard_tokens=1000)
    got = tokenfiles.read_tokens(spark, str(tmp_path / "a")).toPandas().sort_values("start")
    assert len(got) == len(ROWS) and math.isnan(got.doc_id.iloc[0])
    assert (got.start.to_numpy()[1:] == np.cumsum(got.n_tokens)[:-1]).all()
    assert got[got.doc_id.isin([2, 3, 5])].n_tokens.tolist() == [1, 1, 1]
    assert sorted(got[got.doc_id == 4].n_tokens)[0] > 20_000
    tokenfiles.write_tokens(none, str(tmp_path / "b"), WORDS)
    assert tokenfiles.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_wavelet_queries():
    ids = np.random.default_rng(2).integers(0, 700, 5000).astype(np.uint32)
    lengths, docs = np.array([2000, 3000]), np.array([4, 9])
    m, n, d, missing = wavelet.unpack(wavelet.pack(ids, lengths, docs, np.zeros(2, dtype=bool)))
    assert (m.all() == ids).all() and (n == lengths).all() and (d == docs).all() and not missing.any()
    at = np.array([0, 1, 511, 512, 4999])
    assert (m.access(at) == ids[at]).all()
    for symbol in (int(ids[0]), int(ids[77]), 699, 100_000):
        assert m.count(symbol, 300, 4100) == (ids[300:4100] == symbol).sum()
        assert (m.occurrences(symbol) == np.flatnonzero(ids == symbol)).all()
    empty, *_ = wavelet.unpack(wavelet.pack(np.zeros(0, dtype=np.uint32), np.zeros(0), np.zeros(0), np.zeros(0)))
    assert len(empty.all()) == 0 and empty.count(3) == 0


@pytest.mark.parametrize("known_words", [0, 400_000])
def test_token_ids_are_those_of_whole_texts(known_words):
    own = tokenfiles.Encoder(WORDS, known_words)
    texts = ["Hello, WORLD.: a,b ABC:: DON'T q' it's.", "x***$$ é%% 7#. 12a. a1 ÉCOLE naïve, Straße!", "<|endoftext|> <|STARTOFTEXT|> <|startoftext|>. a<|endoftext|>b", "J̌ous Kelvin İx e\u0301t\u0301 ǅ ΣΑΣ", "漢字 日本語。 \u200b x\u00a0y", "."]
    for text in texts:
        words = text.split()
        ids, first, sizes = own.of_words(pa.array(words))
        assert [i for a, n in zip(first, sizes) for i in ids[a : a + n].tolist()] == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_answer_without_decoding(spark, tmp_path):
    random = np.random.default_rng(4)
    rows = [(int(i), " ".join(random.choice(["stone", "river", "mill", "qzq"], int(n)))) for i, n in enumerate(random.integers(0, 40, 60))]
    tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), WORDS, shard_tokens=300, task_chars=2000)
    whole = {r.doc_id: (r.start, r.ids) for r in tokenfiles.read_tokens(spark, str(tmp_path / "a")).collect()}
    starts = np.cumsum([0] + [len(whole[d][1]) for d in sorted(whole)])[:-1]
    assert [whole[d][0] for d in sorted(whole)] == starts.tolist()
    token = tokenfiles.encoder(WORDS).tokenizer.encode("river", add_special_tokens=False).ids[0]
    counts = {(r.doc_id, r.start): r.n for r in tokenfiles.count_tokens(spark, str(tmp_path / "a"), token).collect()}
    assert counts == {(d, s): ids.count(token) for d, (s, ids) in whole.items() if token in ids}
    places = {(r.doc_id, r.at) for r in tokenfiles.occurrences(spark, str(tmp_path / "a"), token).collect()}
    assert places == {(d, k) for d, (_, ids) in whole.items() for k, i in enumerate(ids) if i == token}
    assert tokenfiles.occurrences(spark, str(tmp_path / "a"), 10**6).count() == 0
    assert {r.doc_id: r.ids for r in tokenfiles.tokens_at(spark, str(tmp_path / "a"), 3, 5).collect()} == {d: ids[3:8] for d, (_, ids) in whole.items()}


def test_simhash_edges(wide, none):
    got = simhash.simhash_groups(wide).toPandas()
    assert len(got) == len(ROWS)
    zero = got[got.fingerprint == "0" * 16]
    assert sorted(zero.doc_id) == [2, 3, 5] and set(zero.component_id) == {2}
    assert got[got.doc_id.isna()].component_id.isna().all()
    assert simhash.simhash_groups(none).count() == 0


def test_simhash_large_shards_lose_no_link(spark):
    random = np.random.default_rng(7)
    base = random.integers(0, 2**62, 60, dtype=np.uint64)
    prints = {int(b): None for b in base} | {int(b) ^ sum(1 << int(k) for k in random.choice(64, 3, replace=False)): None for b in base}
    texts = [f"{p:016x}" for p in prints]
    distinct = spark.createDataFrame([(t,) for t in texts], "fingerprint string")
    links = simhash._in_shards(simhash._dealt(distinct, 4, 4, 4, 1), simhash._spanning(3))
    got = {r.node: r.component for r in components(links).collect()}
    wanted = brute.groups(sorted(texts), lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count() <= 3)
    assert {t: got.get(t, t) for t in texts} == wanted


def test_bk_forest_finds_all_pairs():
    prints = np.random.default_rng(1).integers(0, 2**10, (300, 1), dtype=np.uint64)
    prints = np.unique(prints, axis=0)
    shard = np.sort(np.arange(len(prints)) % 3)
    got = {(int(a), int(b)) for x, y, _ in Forest(prints, shard).earlier(2) for a, b in zip(x, y)}
    wanted = {(a, b) for a in range(len(prints)) for b in range(a) if shard[a] == shard[b] and hamming(prints[a : a + 1], prints[b : b + 1])[0] <= 2}
    assert got == wanted


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (None, 3), (1000, 1001)], "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(201)} | {(1000, 1000), (1001, 1000)}


def test_near_duplicates_against_all_pairs(spark):
    random = np.random.default_rng(11)
    word = lambda: "".join(random.choice(list("abcdefgh"), 6))
    rows, at = [], 0
    for size in (1, 2, 3, 6, 12):
        own = [word() for _ in range(120)]
        for copy in range(size):
            mine = list(own)
            for k in random.choice(120, copy % 4, replace=False):
                mine[k] = word()
            rows.append((at := at + 1, " ".join(mine)))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1]), (None, rows[3][1]), (903, "short text"), (904, "Short  text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in CLASHING])
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns and got.where("_digest = 'own' and row = 'own'").count() == got.count()
    texts = {i: t for i, t in rows if i is not None}
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    wanted = brute.groups(sorted(sets), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(wanted.values()))
    joined = simhash.drop_near_duplicates(df, broadcast_keys=0)
    assert sorted(r.doc_id for r in joined.collect()) == sorted(set(wanted.values()))
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def kept_of(spark, texts: list, **options) -> set:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.drop_near_duplicates(df, **options).collect()}


def wanted_of(texts: list) -> set:
    sets = {i: brute.shingles(t) for i, t in enumerate(texts)}
    return set(brute.groups(list(sets), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8).values())


def words_at_random(random, n: int) -> list[str]:
    return [f"w{int(i)}" for i in random.integers(0, 10**6, n)]


def test_near_duplicates_with_a_much_repeated_line(spark):
    random, texts, far = np.random.default_rng(21), [], 0
    for repeats in (10, 20, 40):
        own, line = words_at_random(random, 400), words_at_random(random, 10)
        texts += [" ".join(own[:200] + line + own[200:]), " ".join(own[:200] + line * repeats + own[200:])]
        a, b = (int(simhash.fingerprint(np.unique(simhash.shingles(t, 2)), 256), 16) for t in texts[-2:])
        far = max(far, (a ^ b).bit_count())
    assert far <= 52  # SimHash proposes them itself
    assert kept_of(spark, texts) == wanted_of(texts) == {0, 2, 4}


def test_near_duplicates_that_fingerprints_miss(spark):
    random, texts = np.random.default_rng(22), []
    for k in range(60):
        own = words_at_random(random, 400)
        other = (own + words_at_random(random, (96, 80, 60)[k % 3])) if k % 2 else own[:360] + words_at_random(random, 40)
        texts += [" ".join(own), " ".join(other)]
    wanted = wanted_of(texts)
    assert len(wanted) == 60
    assert kept_of(spark, texts) == kept_of(spark, texts, max_shard=1) == wanted


def test_near_duplicates_within_a_template(spark):
    random, texts = np.random.default_rng(23), []
    template = words_at_random(random, 330)
    for k in range(40):
        own = words_at_random(random, 70)
        texts += [" ".join(template + own)] + ([" ".join(template[:300] + words_at_random(random, 20) + template[320:] + own)] if k % 4 == 0 else [])
    random.shuffle(texts)
    wanted = wanted_of(texts)
    assert len(wanted) == 40
    assert kept_of(spark, texts) == kept_of(spark, texts, max_bucket=3) == wanted
    # the fingerprints propose nothing of use, and all buckets of over one text are dealt again
    assert kept_of(spark, texts, radius=0, max_bucket=1) == wanted


def test_sketches_differ_no_more_than_sets():
    random = np.random.default_rng(25)
    pool = random.integers(0, 2**63, 40_000, dtype=np.uint64)
    sets = [np.unique(random.choice(pool, n)) for n in (0, 1, 30, 40, 300, 380, 9000, 11_000, 30_000)]
    near = [np.unique(np.append(s[: int(0.9 * len(s))], random.choice(pool, max(1, len(s) // 20)))) for s in sets]
    sketches = np.array([simhash.sketch(s) for s in sets + near], dtype=object)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(18), np.arange(18)))
    far = simhash.apart(sketches, a, b)
    assert (far <= [len(np.setxor1d((sets + near)[i], (sets + near)[j])) for i, j in zip(a, b)]).all()
    assert (far[a == b] == 0).all() and far[(a == 4) & (b == 5)][0] > 200


def test_near_duplicates_of_equal_fingerprint(spark):
    random, texts = np.random.default_rng(24), []
    for _ in range(12):  # all nine word pairs of three words
        own = ["a", "a", "b", "b", "c", "c", "a", "c", "b", "a", *random.choice(["a", "b", "c"], 90)]
        texts += [" ".join(own), " ".join([*own, "a", "b"])]
    assert len({simhash.fingerprint(np.unique(simhash.shingles(t, 2)), 256) for t in texts}) == 1
    wanted = wanted_of(texts)
    assert len(wanted) == 12 and kept_of(spark, texts) == wanted


def test_piece_edges(wide, none):
    got = pieces.decode(pieces.encode(wide, PIECES), PIECES)
    assert got.count() == len(ROWS) and got.where("row = 'own'").count() == len(ROWS)
    assert got.where("decoded = coalesce(text, '')").count() == len(ROWS)
    assert got.where("doc_id = 4").select("ids").distinct().count() == 1
    assert pieces.encode(none, PIECES).count() == 0
    checked = pieces.encode(wide.withColumn("lossless", F.lit("own")), PIECES, verify=True)
    assert checked.count() == len(ROWS) and checked.where("lossless").count() == len(ROWS)


@pytest.mark.parametrize("text", ["Hello  world", " a", "a ", "▁ x▁y", "línea\n\nnew\ttab", "😀 ünï 漢字 \u200b", "12345 +-*/", "\n", " "])
def test_pieces_without_dropout_are_the_librarys(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids, _ = pieces.encode_texts([text], ["1"], PIECES, dropout=0.0)
    if "▁" not in text:  # to the library a literal one is a space, which would not decode
        assert ids.tolist() == model.encode(text)
    for dropout in (0.0, 0.5, 1.0):
        ids, _ = pieces.encode_texts([text], ["1"], PIECES, dropout=dropout)
        assert pieces.decode_ids(ids, pieces.vocabulary(PIECES).spelled) == text


def plain_agenda(unit: str, place_key: int, v, dropout: float, seed: int) -> list[int]:
    """One candidate after the other: all pairs are looked at anew after each merger."""
    import zlib

    mix = lambda x: int(pieces.mix64(np.array([x % 2**64], dtype=np.uint64))[0])
    key = mix(mix(zlib.crc32(unit.encode()) ^ place_key) ^ mix(seed))
    known = dict(zip(v.pairs.tolist(), zip(v.rank.tolist(), v.merged.tolist())))
    spans = [(i, i + 1, int(v.single[ord(c)])) for i, c in enumerate(unit)]
    while True:
        open_ = []
        for k, ((a, b, x), (_, c, y)) in enumerate(zip(spans, spans[1:])):
            if x >= 0 and y >= 0 and (x << 32 | y) in known and (not dropout or mix(key ^ mix(a << 40 | b << 20 | c)) >= int(dropout * 2.0**64)):
                open_.append((known[x << 32 | y][0], a, k))
        if not open_:
            return [x for _, _, x in spans]
        _, _, k = min(open_)
        (a, _, x), (_, c, y) = spans[k : k + 2]
        spans[k : k + 2] = [(a, c, known[x << 32 | y][1])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_merging_follows_a_plain_agenda(dropout, monkeypatch):
    random, v = np.random.default_rng(12), pieces.vocabulary(PIECES)
    units = [" international", "aaaaaaaaaaaa", " the", "qzqzq", " misunderstandings", "x"] + ["".join(random.choice(list("aeinrst"), int(n))) for n in random.integers(1, 60, 40)]
    keys = random.integers(0, 2**63, len(units), dtype=np.uint64)
    wanted = [plain_agenda(u, int(k), v, dropout, 42) for u, k in zip(units, keys)]
    for long in (10**6, 2):
        monkeypatch.setattr(pieces, "LONG", long)
        ids, bounds = pieces.merge(units, keys, v, dropout, 42)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == wanted


def test_long_texts_are_cut_at_units_and_long_units_end(monkeypatch):
    random = np.random.default_rng(13)
    text = " ".join("".join(random.choice(list("abcdeé漢 \n▁"), 9)) for _ in range(900))
    whole = pieces.encode_texts([text, "a b", text], ["1", "2", "3"], PIECES)
    monkeypatch.setattr(pieces, "SLICE_BYTES", 500)
    cut = pieces.encode_texts([text, "a b", text], ["1", "2", "3"], PIECES)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    unit = "".join(random.choice(list("abcdefghij"), 40_000))
    ids, _ = pieces.encode_texts([unit], ["1"], PIECES)
    assert pieces.decode_ids(ids, pieces.vocabulary(PIECES).spelled) == unit


def test_dropout_is_seeded():
    one = lambda key, seed: pieces.encode_texts([LONG[:3000]], [key], PIECES, seed=seed)[0].tolist()
    assert one("1", 1) == one("1", 1) and one("1", 1) != one("1", 2) and one("1", 1) != one("2", 1)

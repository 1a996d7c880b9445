import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from brookmill.llm import simhash
from brookmill.llm.common import small_batches

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it made."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        out[name] = (docs.toPandas(), made.toPandas())
        docs = made
    return out


def test_filters_keep_the_columns_and_only_drop(stages):
    for name, (given, made) in list(stages.items())[:-1]:
        assert list(made.columns) == list(given.columns), name
        assert set(made.doc_id) <= set(given.doc_id) and 0 < len(made) <= len(given), name


def test_language_and_toxicity_drop_few(stages):
    labels = pd.read_parquet(f"{SF}/labels.parquet").groupby("doc_id").max()
    given, made = stages["toxicity"]
    gone = set(given.doc_id) - set(made.doc_id)
    clean = set(labels[labels.toxic == 0].index) & set(given.doc_id)
    toxic = set(labels[labels.toxic == 1].index) & set(given.doc_id)
    assert len(gone & clean) <= 0.05 * len(clean) and len(gone & toxic) >= 0.5 * len(toxic)
    given, made = stages["language"]
    gone = given[~given.doc_id.isin(made.doc_id)]
    assert gone.text.fillna("").map(lambda t: not any(c.isalpha() for c in t)).all()


def test_one_document_of_each_group_stays(stages):
    given, made = stages["near_duplicates"]
    sets = {d: brute.shingles(t) for d, t in zip(given.doc_id, given.text)}
    wanted = brute.groups(sorted(sets), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    assert sorted(made.doc_id) == sorted(set(wanted.values()))


def test_no_item_stays_and_clean_documents_do(stages):
    items = [" ".join(brute.words(t)) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    given, made = stages["decontamination"]
    leaks = {d for d, t in zip(given.doc_id, given.text) if any(i in " ".join(brute.words(t)) for i in items)}
    gone = set(given.doc_id) - set(made.doc_id)
    assert leaks <= gone and len(gone) < 0.2 * len(given)


def test_the_end_is_lossless_and_run_gives_the_same(spark, stages):
    given, made = stages["pieces"]
    assert made.lossless.all() and sorted(made.doc_id) == sorted(given.doc_id)
    assert sorted(corpus_pipeline.run(spark, SF).toPandas().doc_id) == sorted(made.doc_id)


def test_rows_go_to_workers_in_small_batches(spark):
    name, kept = "spark.sql.execution.arrow.maxBytesPerBatch", None
    kept = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        docs = spark.range(40).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 60000) AS text", "'en' AS lang", "'s' AS source").coalesce(1)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF)  # any stage sets it

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

        seen = docs.mapInArrow(sizes, "n long, size long").toPandas()
        assert seen.n.sum() == 40 and seen["size"].max() < 5 << 20
        spark.conf.set(name, "1000000")
        small_batches(spark)
        assert int(spark.conf.get(name).removesuffix("b")) == 1_000_000
    finally:
        spark.conf.set(name, kept.removesuffix("b"))


def test_buckets_hold_few_rows_and_pairs_at_once():
    rng, n, wide = np.random.default_rng(1), 60_000, simhash.MAX_SKETCH // 8
    twins = rng.integers(0, 256, (n // 600, wide), dtype=np.uint8)

    def batches():
        for start in range(0, n, 600):  # a bucket of 600 rows, of which two are alike
            rows = rng.integers(0, 256, (600, wide), dtype=np.uint8)
            rows[0] = rows[-1] = twins[start // 600]
            at = np.arange(start, start + 600)
            columns = [np.full(600, start), at, at, np.full(600, 4000, dtype=np.int32), np.zeros(600, dtype=np.int32), np.full(600, -1, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([r.tobytes() for r in rows], pa.binary())], simhash._Buckets.COLUMNS)

    tracemalloc.start()
    try:
        found = [p for b in simhash._Buckets(0.8)(batches()) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(found) == [(k, k + 599) for k in range(0, n, 600)]
    assert peak < 96 << 20, peak


def test_pairs_that_cannot_be_alike_go_before_texts_are_read(spark, monkeypatch):
    rng, texts = np.random.default_rng(2), []
    base = [f"word{k}" for k in range(160)]
    for k in range(200):  # by two-word shingles near each other, by five-word shingles far below 0.8
        own = list(base)
        for at in rng.choice(160, 6, replace=False):
            own[at] = f"x{k}y{at}"
        texts += [" ".join(own), " ".join([*own, "end"])] if k < 40 else [" ".join(own)]
    counts, saved = [], simhash.saved

    def counted(df):
        out = saved(df)
        if out.columns == ["digest_a", "digest_b"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(simhash, "saved", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs).toPandas()
    sets = [brute.shingles(t) for t in texts]
    wanted = brute.groups(list(range(len(texts))), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    assert sorted(kept.doc_id) == sorted(set(wanted.values())) and len(kept) <= 200
    assert 40 <= sum(counts) <= 240, counts


def test_files_of_shuffles_go_with_their_query(spark, tmp_path):
    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name for d in dirs for f in Path(d.getPath()).glob("*/shuffle_*.data")}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = files()
    corpus_pipeline.STAGES[2][1](spark, docs, SF).write.parquet(str(tmp_path / "out"))
    left = len(files() - before)
    rows = docs.groupBy("lang").count()
    assert left <= 2 and sorted(rows.collect(), key=str) == sorted(rows.collect(), key=str)

import json

import pytest
from pyspark.sql import functions as F

from brookmill.sources import batches
from brookmill.streaming import arrivals, intake

HOTLIST = "Name | Title\nAnn Bee | Developer\nCy Dee | "
BATCHES = [
    [{"id": "a", "kind": "hotlist", "text": HOTLIST}, {"id": "a", "kind": "note", "text": "same id"}, {"id": "b", "kind": "job_description", "text": "Job Title: QA Tester\nCompany: Acme\nRequired Skills: SQL"}],
    [{"id": "a", "kind": "hotlist", "text": "late copy"}, {"id": "c", "status": 503}, {"id": "d", "status": 404}, "{nope", {"kind": "note"}],
    [{"id": "c", "attempt": 1, "status": 503}, {"id": "c", "status": 503}, "{nope", {"id": "e", "kind": "other", "text": None}],
]


def fill(spark, path, lines):
    texts = [(x if isinstance(x, str) else json.dumps(x),) for x in lines]
    spark.createDataFrame(texts, "value string").coalesce(1).write.mode("append").text(path)


def start(spark, source, root, checkpoint):
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(source).select(F.col("value").alias("body"))
    arrivals.run(raw, root, checkpoint).awaitTermination()


def tables(spark, root):
    out = {}
    for name, schema in arrivals.TABLES.items():
        rows = batches.committed(spark, root, name, schema).drop("_batch")
        out[name] = sorted(map(str, rows.collect()))
    return out


def test_tables_of_one_stream(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for lines in BATCHES:
        fill(spark, source, lines)
        start(spark, source, root, checkpoint)
    read = lambda name: batches.committed(spark, root, name, arrivals.TABLES[name])
    drafts = {r.draft_id: r for r in read("drafts").collect()}
    assert sorted(drafts) == ["a", "b", "e"]
    assert [c.name for c in drafts["a"].consultants] == ["Ann Bee", "Cy Dee"] and drafts["a"].confidence == 0.62
    assert drafts["b"].positions[0].job_title == "QA Tester" and drafts["e"].warnings == ["unsupported_email_document_kind"]
    assert {(r.draft_id, r.record, r.field, r.value) for r in read("provenance").collect()} == {
        ("a", 2, "name", "Ann Bee"), ("a", 2, "title", "Developer"), ("a", 3, "name", "Cy Dee"),
        ("b", 1, "job_title", "QA Tester"), ("b", 1, "company", "Acme"), ("b", 1, "skills", '["SQL"]'),
    }
    assert sorted((r.id, r.attempt, r.wait) for r in read("retries").collect()) == [("c", 1, 5), ("c", 2, 15)]
    assert sorted((r.id or "", r.reason) for r in read("dead_letters").collect()) == [("", "bad_json"), ("", "missing_id"), ("d", "status_404")]
    assert read("log").count() == 8


def test_a_batch_killed_between_two_tables(spark, tmp_path, monkeypatch):
    """After a crash in any batch, before any of its tables, a rerun ends with the tables of a run without one."""
    source, whole = str(tmp_path / "in"), str(tmp_path / "whole")
    for lines in BATCHES[:2]:
        fill(spark, source, lines)
    start(spark, source, whole, str(tmp_path / "cp"))
    wanted, put = tables(spark, whole), batches.put
    assert any(wanted.values())
    for victim, batch in (("drafts", 0), ("log", 1)):
        root, checkpoint = str(tmp_path / f"out-{victim}"), str(tmp_path / f"cp-{victim}")

        def failing(rows, root, name, number, victim=victim, batch=batch):
            if (name, number) == (victim, batch):
                raise RuntimeError("killed")
            return put(rows, root, name, number)

        monkeypatch.setattr(batches, "put", failing)
        with pytest.raises(Exception, match="killed"):
            start(spark, source, root, checkpoint)
        assert batches.last(spark, root) == batch - 1  # readers see none of its tables
        assert all("killed" not in r for rows in tables(spark, root).values() for r in rows)
        monkeypatch.setattr(batches, "put", put)
        start(spark, source, root, checkpoint)
        assert tables(spark, root) == wanted


def test_first_arrivals_by_order_and_null_keys(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "cp"))
    schema = "key string, text string, at string"
    for rows in ([("a", "late", "2"), ("a", "first", "1"), (None, "x", "1")], [("a", "earlier by time", "0"), (None, "y", "0"), ("b", "z", "1")], []):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").option("ignoreNullFields", False).json(source)
        intake.write_new(intake.read_json_stream(spark, source, schema), state, ["key"], ["at"], checkpoint).awaitTermination()
    assert {(r.key, r.text) for r in spark.read.parquet(state).collect()} == {("a", "first"), (None, "x"), ("b", "z")}

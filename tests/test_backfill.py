import pytest
from pyspark.sql import functions as F

from brookmill.operators import backfill, projection
from brookmill.sources import batches

ROWS = "id long, version long, value string, open boolean"


def target(spark):
    return spark.range(10).select("id", F.lit(1).cast("long").alias("version"), F.concat(F.lit("v"), F.col("id") % 4).alias("value"), (F.col("id") != 6).alias("open"))


def prepare(rows):
    return rows.select("id", F.when(F.col("id") % 4 == 0, F.col("value")).otherwise(F.upper("value")).alias("value"), F.when(F.col("id") == 7, "Broken").alias("error"))


def frozen(spark, root, dry_run=False, size=3):
    backfill.create(target(spark).withColumn("at", -F.col("id")).select("id", "version", "at"), root, ["at"], size, dry_run)


def results(spark, root):
    rows = {(r.id, r.batch, r.outcome, r.error) for r in backfill.outcomes(spark, root).collect()}
    changed = backfill.applied(target(spark), backfill.updates(spark, root, "id long, version long, value string"))
    return rows, sorted(map(tuple, changed.collect()))


def test_numbers_in_order(spark, tmp_path):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("id"), (F.col("id") % 2).alias("hot"))
    got = backfill.numbered(rows, ["hot", "id"], str(tmp_path)).collect()
    assert sorted(r.place for r in got) == list(range(5000))
    assert [(r.hot, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted((r.hot, r.id) for r in got)


def test_stop_after_any_batch_and_resume(spark, tmp_path, monkeypatch):
    whole, steps = str(tmp_path / "whole"), str(tmp_path / "steps")
    frozen(spark, whole)
    done = backfill.run(spark, whole, lambda: target(spark), prepare)
    assert done == {"state": "completed_with_errors", "total": 10, "processed": 10, "changed": 5, "unchanged": 3, "skipped": 1, "failed": 1}
    wanted = results(spark, whole)
    assert (9, 0, "changed", None) in wanted[0] and (7, 0, "failed", "Broken") in wanted[0] and (6, 1, "skipped", None) in wanted[0]
    assert (9, 2, "V1", True) in wanted[1] and (8, 1, "v0", True) in wanted[1] and len(wanted[1]) == 10

    frozen(spark, steps)
    assert backfill.run(spark, steps, lambda: target(spark), prepare, most=1)["state"] == "running"
    assert backfill.control(spark, steps, "pause") and not backfill.control(spark, steps, "pause")
    assert backfill.run(spark, steps, lambda: target(spark), prepare)["processed"] == 3  # paused
    assert backfill.control(spark, steps, "resume")
    put = batches.put

    def failing(rows, root, name, number):
        if (name, number) == ("updates", 1):
            raise RuntimeError("killed")
        return put(rows, root, name, number)

    monkeypatch.setattr(batches, "put", failing)
    with pytest.raises(RuntimeError):
        backfill.run(spark, steps, lambda: target(spark), prepare)
    monkeypatch.setattr(batches, "put", put)
    assert backfill.status(spark, steps)["processed"] == 3
    frozen(spark, steps)  # asking again changes nothing
    backfill.run(spark, steps, lambda: target(spark), prepare)
    assert results(spark, steps) == wanted
    with pytest.raises(ValueError):
        frozen(spark, steps, size=4)


def test_edits_cancel_and_dry_run(spark, tmp_path):
    root, dry, none = (str(tmp_path / x) for x in ("a", "dry", "none"))
    frozen(spark, root)
    edited = target(spark).where("id != 3").withColumn("version", F.when(F.col("id") == 9, 2).otherwise(F.col("version")).cast("long"))
    backfill.run(spark, root, lambda: edited, prepare, most=3)
    assert backfill.control(spark, root, "cancel") and not backfill.control(spark, root, "resume")
    assert backfill.run(spark, root, lambda: edited, prepare)["state"] == "cancelled"
    skipped = {r.id for r in backfill.outcomes(spark, root).where("outcome = 'skipped'").collect()}
    assert skipped == {9, 6, 3}  # edited, closed, gone
    late = spark.createDataFrame([(5, 7, "edited since", True), (1, 1, "v1", True)], ROWS)
    assert sorted(map(tuple, backfill.applied(late, backfill.updates(spark, root, "id long, version long, value string")).collect())) == [(1, 2, "V1", True), (5, 7, "edited since", True)]
    frozen(spark, dry, dry_run=True)
    assert backfill.run(spark, dry, lambda: target(spark), prepare)["changed"] == 5
    assert backfill.updates(spark, dry, "id long, version long, value string").count() == 0
    backfill.create(target(spark).where("false"), none, ["id"], 3)
    assert backfill.run(spark, none, lambda: target(spark), prepare)["state"] == "completed"


DRAFTS = "draft_id long, domain string, label string, method string, observed_at string, updated_at string"


def observe(drafts):
    return drafts.select("draft_id", "domain", "label", "method", F.col("observed_at").cast("timestamp").alias("observed_at"), F.when(F.col("domain").isNull(), "none").otherwise("linked").alias("reason"))


def test_projection_equals_a_full_one(spark, tmp_path):
    def drafts(*rows):
        return spark.createDataFrame(list(rows), DRAFTS).withColumn("updated_at", F.col("updated_at").cast("timestamp"))

    steps = [
        drafts((1, "a.io", "A", "signature", "2024-01-01", "2024-01-01"), (2, "a.io", "A Inc", "sender_domain", "2024-01-02", "2024-01-01"), (3, "b.io", "B", "signature", "2024-01-01", "2024-01-01")),
        drafts((1, "b.io", "Bee", "signature", "2024-01-01", "2024-01-02"), (2, "a.io", "A Inc", "sender_domain", "2024-01-02", "2024-01-01"), (3, "b.io", "B", "signature", "2024-01-01", "2024-01-01"), (4, "b.io", "Bee", "signature", "2024-01-01", "2024-01-01")),
        drafts((2, "a.io", "Right", "human_edited", "2024-01-02", "2024-01-03"), (4, None, None, None, None, "2024-01-04"), (3, "b.io", "B", "signature", "2024-01-01", "2024-01-01")),
    ]
    looked = []

    def watching(rows):
        looked.append(sorted(r.draft_id for r in rows.select("draft_id").collect()))
        return observe(rows)

    for k, source in enumerate(steps):
        state = projection.advance(source, str(tmp_path), watching, "1")
        full = projection.step(source, projection.empty(spark), observe, "1")
        for name in ("observations", "seen", "companies"):
            assert sorted(map(str, getattr(state, name).collect())) == sorted(map(str, getattr(full, name).collect())), (k, name)
    assert looked == [[1, 2, 3], [1, 4], [2, 4]]
    assert {(r.domain, r.name) for r in state.companies.collect()} == {("a.io", "Right"), ("b.io", "B")}
    projection.advance(steps[2], str(tmp_path), watching, "2")
    assert looked[-1] == [2, 3, 4]  # another version looks at everything again


def test_verified_and_unnamed_companies_keep_their_names(spark):
    base = projection.empty(spark)
    kept = spark.createDataFrame([("a.io", "Chosen", True), ("old.io", "Old", False)], projection.COMPANIES)
    source = spark.createDataFrame([(1, "a.io", "A", "signature", None, None)], DRAFTS).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    out = projection.step(source, projection.State(base.observations, kept, base.seen), observe, "1")
    assert {tuple(r) for r in out.companies.collect()} == {("a.io", "Chosen", True), ("old.io", "Old", False)}

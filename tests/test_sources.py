import base64
import json
import time

import pytest
from pyspark.sql import functions as F

from brookmill.sources import files, messages
from brookmill.streaming import intake


def test_json_lines_round_trip_and_bad_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_json_lines(spark.createDataFrame([(1, "a")], "id int, v string"), path)
    files.append_json_lines(spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), path)
    (tmp_path / "log" / "bad.json").write_text("{nope\n")
    state = spark.createDataFrame([(2, "old")], "id int, v string")
    got = files.import_json_lines(spark, path, "id int, v string", state, ["id"], ["v"])
    assert [tuple(r) for r in got.collect()] == [(1, "a")]


def test_company_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("﻿company_name,domain,source,source_url,location,careers_url\nAcme,acme.io,list,https://l.com/1?x=1,TX,\nAcme B,www.acme.io,list,https://l.com/1,TX,\n,b.io,list,https://l.com/2,,\nGoo,gmail.com,list,https://l.com/3,,\nUrl,u.io,list,nope,,\n", encoding="utf-8")
    got = {r.company_name: r.error for r in files.read_companies(spark, str(path)).collect()}
    assert got == {"Acme": None, "Acme B": "duplicate_in_file", None: "name_missing", "Goo": "domain_invalid", "Url": "url_invalid"}
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_companies(spark, str(path))


def test_attachments(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hé")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "c.md").write_text("")
    read = files.read_attachments(spark, str(tmp_path))
    assert {r.path.rsplit("/")[-1]: r.error for r in read.collect()} == {"a.txt": None, "b.exe": "extension_not_allowed"}
    assert [r.text for r in files.attachment_texts(read).where("text is not null").collect()] == ["hé"]


def test_providers_share_a_schema(spark):
    one = lambda payload: spark.createDataFrame([(json.dumps(payload),)], "payload string")
    body = base64.urlsafe_b64encode("hé?>".encode()).decode()
    sources = [
        messages.email_webhook(one({"from": "Ann <A@x.com>", "subject": "S", "html": "<p>hi</p>", "message_id": "m1", "date": "2024-01-01T00:00:00Z"})),
        messages.gmail(one({"id": "g1", "internalDate": "1704067200000", "payload": {"headers": [{"name": "From", "value": "b@y.com"}], "parts": [{"mimeType": "text/plain", "body": {"data": body}}]}})),
        messages.graph(one({"id": "o1", "subject": "", "from": {"emailAddress": {"address": "C@z.com", "name": "C"}}, "body": {"contentType": "html", "content": "a<br>b"}, "receivedDateTime": "2024-01-01T00:00:00Z"})),
        messages.slack(one({"event": {"client_msg_id": "s1", "user": "u", "text": "t", "ts": "1704067200.5"}})),
        messages.whatsapp(one({"messages": [{"id": "w1", "text": {"body": "t"}, "timestamp": "1704067200"}], "contacts": [{"profile": {"name": "N"}}]})),
    ]
    got = {r.source_message_id: (r.channel, r.sender_email, r.text) for r in messages.together(*sources).collect()}
    assert got["m1"] == ("email", "a@x.com", "Subject: S\nhi") and got["g1"] == ("gmail", "b@y.com", "hé?>")
    assert got["o1"] == ("outlook", "c@z.com", "a\nb") and got["s1"][0] == "slack" and got["w1"] == ("whatsapp", None, "t")


def test_mailbox_kind(spark):
    boxes = {"jobs@x.com": "job", "hot@x.com": "hotlist"}
    kind = lambda r: spark.range(1).select(messages.mailbox_kind(F.lit(r), boxes)).first()[0]
    assert kind("Jobs <jobs@x.com>; z@z.com") == "job" and kind("jobs@x.com, hot@x.com") is None and kind("") is None


def test_poison_and_retries(spark):
    raw = spark.createDataFrame([('{"id": "a"}',), ("{nope",), ("{}",), ("[1]",)], "body string")
    assert {r.body: r.poison for r in intake.routed(raw, "id string", ("id",)).collect()} == {'{"id": "a"}': None, "{nope": "bad_json", "{}": "missing_id", "[1]": "wrong_root"}
    plan = lambda attempt, status, after=None: tuple(spark.range(1).select(intake.retry_plan(F.lit(attempt), F.lit(status), F.lit(after).cast("int"))).first()[0])
    assert [plan(0, 500), plan(4, 500), plan(5, 500), plan(0, 404), plan(1, 200), plan(0, 429, 7)] == [("retry", 5), ("retry", 900), ("dead_letter", None), ("dead_letter", None), ("done", None), ("retry", 7)]


def test_stream_effects_happen_once(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "cp"))
    schema = "key string, text string, at timestamp"
    for batch in ([("a", "1", "2024-01-01"), ("a", "2", "2024-01-02")], [("a", "3", "2024-01-03"), ("b", "4", "2024-01-03")]):
        spark.createDataFrame(batch, "key string, text string, at string").coalesce(1).write.mode("append").json(source)
        intake.write_new(intake.read_json_stream(spark, source, schema), state, ["key"], ["at"], checkpoint).awaitTermination()
    assert sorted((r.key, r.text) for r in spark.read.parquet(state).collect()) == [("a", "1"), ("b", "4")]


def test_sessions(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("c", "u", None, "text", 2), ("c", "v", None, "x", 1), ("c", "u", "post", None, 1)]  # the answer is read before its action
    spark.createDataFrame(rows, "channel string, user_id string, action string, text string, at long").coalesce(1).write.option("ignoreNullFields", False).json(source)
    stream = intake.sessions(intake.read_json_stream(spark, source, "channel string, user_id string, action string, text string, at long"))
    query = stream.writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            if spark.table("sessions").count() >= 3:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert sorted((r.user_id, r.status) for r in spark.table("sessions").collect()) == [("u", "received"), ("u", "waiting"), ("v", "idle")]

"""Places of terms against a scan of each phrase by itself."""

import random
import re

import pytest

from brookmill.operators import places

PHRASES = [("Node JS", "Node.js", "alias"), ("node.js", "Node.js", "canonical"), ("C++", "C++", "canonical"), ("C", "C", "canonical"), ("k8s", "Kubernetes", "alias"), (".NET", ".NET", "canonical"), ("a a", "Doubled", "alias"), ("Straße", "Road", "alias"), ("sql", "SQL", "canonical"), ("SQL", "Structured", "alias"), ("sql server", "SQL Server", "canonical"), (" ", "Nothing", "alias")]


def plain(text, entries):
    found = set()
    for phrase, canonical, kind in entries:
        for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(phrase)}(?![A-Za-z0-9])", text, re.IGNORECASE):
            found.add((m[0], canonical, kind, m.start(), m.end()))
    return found


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_places_against_a_scan(spark, block):
    pick = random.Random(3)
    parts = [p[0] for p in PHRASES] + ["x", "1", " ", ", ", "é", "\n", "(", "ſql", "K8s", "İ", "STRASSE", "STRAßE", "a", "nodejs"]
    texts = [None, "", *["".join(pick.choices(parts, k=pick.randint(1, 30))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    dictionary = spark.createDataFrame(PHRASES, "alias string, canonical string, kind string")
    entries = [tuple(r) for r in places.phrases(dictionary).collect()]
    got: dict = {}
    for r in places.term_places(df, dictionary, "id", "text", block).collect():
        row = (r.raw_text, r.canonical, r.kind, r.start, r.end)
        assert row not in got.setdefault(r.id, set())
        got[r.id].add(row)
    assert got == {k: p for k, t in enumerate(texts) if t and (p := plain(t, entries))}
    best = {(r.id, r.canonical): (r.kind, r.start) for r in places.best_places(places.term_places(df, dictionary, "id", "text"), "id").collect()}
    for k, own in got.items():
        for canonical in {p[1] for p in own}:
            assert best[k, canonical] == min(((p[2] != "canonical", p[3], p[2]) for p in own if p[1] == canonical))[2:0:-1]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "sql")], "id long, text string")
    dictionary = spark.createDataFrame(PHRASES, "alias string, canonical string, kind string")
    assert places.term_places(df.limit(0), dictionary, "id", "text").count() == 0
    assert places.term_places(df, dictionary.limit(0), "id", "text").count() == 0

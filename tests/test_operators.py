import pytest
from pyspark.sql import functions as F

from brookmill import schemas
from brookmill.operators import extract, matching, parsers, relational, taxonomy, understanding, upkeep


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_page_is_clamped_to_the_last(spark):
    df = spark.range(7)
    assert rows(relational.page(df, [F.asc("id")], 9, 3), "id") == [(6,)]


def test_first_seen_links_and_keeps_all(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 1), (4, None, 1)], "id int, h string, t int")
    got = {r.id: r.duplicate_of for r in relational.first_seen(df.na.fill("", ["h"]), "h", ["t", "id"], "id").collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None}


def test_upserts(spark):
    state = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, None), ("c", 1, "z")], "k string, t int, v string")
    assert rows(relational.upsert(state, new, ["k"], ["t"]), "k") == [("a", 2, None), ("b", 1, "y"), ("c", 1, "z")]
    assert rows(relational.upsert_keeping(state, new, ["k"]), "k") == [("a", 2, "x"), ("b", 1, "y"), ("c", 1, "z")]


def test_several_changes_and_null_keys_make_one_row_each(spark):
    state = spark.createDataFrame([("a", 1, "x"), (None, 1, "n")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 3, None), ("a", 2, "y"), (None, 2, None), ("b", 1, None), ("b", 1, None)], "k string, t int, v string")
    assert rows(relational.upsert_keeping(state, new, ["k"], ["t"]), "k") == [(None, 2, "n"), ("a", 3, "y"), ("b", 1, None)]
    more = spark.createDataFrame([(None, 9, "again"), ("c", 2, "second"), ("c", 1, "first"), ("a", 5, "old")], "k string, t int, v string")
    assert rows(relational.insert_new(state, more, ["k"], [F.asc("t")]), "k") == [("c", 1, "first")]
    two = relational.insert_new(state.where("k is not null"), more, ["k", "v"], [F.asc("t")])
    assert two.count() == 4


def test_several_learned_rows_double_nothing(spark):
    df = spark.createDataFrame([("d", ""), ("e", "own")], "k string, v string")
    learned = spark.createDataFrame([("d", "two"), ("d", "one"), ("d", ""), ("e", "x"), ("e", "y")], "k string, v string")
    assert rows(relational.fill_gaps(df, learned, ["k"], ["v"]), "k") == [("d", "one"), ("e", "own")]


@pytest.mark.parametrize("back", [False, True])
def test_the_canonical_kind_wins_in_any_order(spark, back):
    entries = [("Java", "Java", "canonical"), ("java", "Java", "alias")]
    dictionary = spark.createDataFrame(entries[::-1] if back else entries, "alias string, canonical string, kind string")
    df = spark.createDataFrame([(1, "We use java here")], "id int, text string")
    assert rows(taxonomy.found_terms(df, dictionary, "id", "text").select("canonical", "kind"), "kind") == [("Java", "canonical")]


LINES = {
    "Requirements:": "approve",
    "WHAT YOU'LL DO": "approve",
    "This email is confidential and meant for one reader": "approve",
    "Equal opportunity for all": "approve",
    "Equal opportunity " + "x" * 181: "review",
    "To apply, please send us your latest CV": "approve",
    "Excellent written and verbal communication and analytical skills!": "approve",
    "Ability to manage multiple priorities in a fast-paced environment": "approve",
    "Strong Java skills": "review",
    "- anything listed": "reject",
    "y" * 221: "reject",
    "Needs 5+ yrs of it": "reject",
    "Job title: clerk": "reject",
    "our office is nice": "review",
    "": "review",
}


def test_boilerplate_lines(spark):
    df = spark.createDataFrame(list(LINES.items()), "line string, wanted string")
    got = df.select("line", "wanted", upkeep.boilerplate_decision(F.col("line")).alias("made")).collect()
    assert not [r for r in got if r.wanted != r.made]


def test_company_observations_plan_stays_small(spark):
    c = F.col
    df = spark.createDataFrame([("Acme", "a@x.mail.acme.io", None, "z@gmail.com"), ("Acme", "a@eu.gmail.com", "https://www.web.io.", "q@notgmail.com"), (None, None, None, "q@notgmail.com")], "n string, c string, w string, s string")
    made = df.select(upkeep.company_observation(c("n"), c("c"), c("w"), c("s")).alias("o"))
    assert [(r.o.domain, r.o.method) for r in made.collect()] == [("x.mail.acme.io", "signature"), ("web.io", "signature"), ("notgmail.com", "sender_domain")]
    assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_domain_block_wins_over_email(spark):
    df = spark.createDataFrame([("a@x.com", "x.com"), ("b@y.com", "y.com"), ("c@z.com", "z.com")], "e string, d string")
    block = spark.createDataFrame([("email", "a@x.com"), ("domain", "x.com"), ("email", "b@y.com")], "match_type string, value string")
    assert rows(relational.blocked(df, block, "e", "d").select("e", "blocked_by"), "e") == [("a@x.com", "domain"), ("b@y.com", "email"), ("c@z.com", None)]


def test_fill_gaps_and_lookup(spark):
    df = spark.createDataFrame([("d", "", 1), ("d", "own", 2), ("e", None, 3)], "k string, v string, n int")
    learned = spark.createDataFrame([("d", "learned")], "k string, v string")
    assert rows(relational.fill_gaps(df, learned, ["k"], ["v"]).select("n", "v"), "n") == [(1, "learned"), (2, "own"), (3, None)]
    names = spark.createDataFrame([("k8s", "Kubernetes")], "key string, canonical string")
    terms = spark.createDataFrame([("K8s",), ("go",)], "t string")
    assert rows(relational.lookup(terms, names, F.lower("t")), "t") == [("K8s", "Kubernetes"), ("go", None)]


def test_found_terms_prefer_canonical(spark):
    dictionary = spark.createDataFrame([("Kubernetes", "Kubernetes", "canonical"), ("k8s", "Kubernetes", "alias"), ("machine learning", "Machine Learning", "canonical")], "alias string, canonical string, kind string")
    docs = spark.createDataFrame([(1, "K8s, then Kubernetes; Machine-Learning!"), (2, None), (3, "")], "id int, text string")
    assert rows(taxonomy.found_terms(docs, dictionary, "id", "text").select("id", "canonical", "kind", "hits"), "canonical") == [(1, "Kubernetes", "canonical", 2), (1, "Machine Learning", "canonical", 1)]


def test_fuzzy_resolution_needs_a_margin(spark):
    dictionary = spark.createDataFrame([("postgresql", "PostgreSQL", "canonical"), ("javascript", "JavaScript", "canonical"), ("kubernetesa", "One", "canonical"), ("kubernetesb", "Two", "canonical")], "alias string, canonical string, kind string")
    terms = spark.createDataFrame([("postgressql",), ("kubernetes",), ("javascriptt",), ("go",)], "t string")
    assert dict(rows(taxonomy.resolve_fuzzy(terms, dictionary, "t").select("t", "canonical"), "t")) == {"postgressql": "PostgreSQL", "kubernetes": None, "javascriptt": "JavaScript", "go": None}


def test_fuzzy_resolution_against_all_pairs(spark):
    names = ["customer relationship management platform", "customer relations management platform", "abababababababababab", "senior software engineer", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "kubernetes", "postgresql", "machine learning engineer in test"]
    terms = ["ustomer relationship management platfor", "xustomer relationship management platforx", "babababababababababa", "senior software enginee", "senior xsoftware engineer", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "kubernetes", "ubernetes", "machine learnin engineer in tests", "postgresq"]
    from brookmill.functions.fuzzy import indel_ratio

    wanted = {}
    for t in terms:
        scores = sorted(((indel_ratio(t, n), n) for n in names), reverse=True)
        wanted[t] = scores[0][1] if scores[0][0] >= 94 and scores[0][0] - scores[1][0] >= 3 else None
    dictionary = spark.createDataFrame([(n, n, "canonical") for n in names], "alias string, canonical string, kind string")
    got = taxonomy.resolve_fuzzy(spark.createDataFrame([(t,) for t in terms], "t string"), dictionary, "t")
    assert {r.t: r.canonical for r in got.collect()} == wanted and len(set(wanted.values())) > 4


def test_found_terms_are_the_same_inline_and_joined(spark):
    dictionary = spark.createDataFrame([("a b", "AB", "canonical"), ("b", "B", "canonical"), ("bb a b", "AB", "alias"), ("c++", "C++", "canonical"), ("a b c d", "long", "canonical")], "alias string, canonical string, kind string")
    docs = spark.createDataFrame([(1, "A b, bb a-b c++"), (2, None), (3, ""), (4, "x bb a b bb a b"), (5, "b b b"), (6, "a b c d")], "id int, text string")
    one, two = (rows(taxonomy.found_terms(docs, dictionary, "id", "text", 3, n), "id", "canonical") for n in (100, 0))
    assert one == two and (4, "AB", "canonical", 3, 4) in one and not [r for r in one if r[1] == "long"]


def test_first_seen_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 3), (3, "b", 1)], "id int, h string, t int")
    assert {r.id: r.duplicate_of for r in relational.first_seen(df, "h", ["t", "id"], "id").collect()} == {1: 2, 2: None, 3: None}


def test_partial_ratio(spark):
    from brookmill.functions.fuzzy import partial_ratio

    rows_ = [("java", "senior java developer"), ("abcd", "xxabyy"), ("", ""), ("", "a"), (None, "a"), ("same", "same"), ("jav", "va")]
    got = [r[0] for r in spark.createDataFrame(rows_, "a string, b string").coalesce(1).select(partial_ratio("a", "b")).collect()]
    assert got == [100.0, 50.0, 100.0, 0.0, None, 100.0, pytest.approx(200 / 3)]


@pytest.mark.parametrize(("text", "wanted"), [("write to ann.b+c@mail.example.org.", "ann.b+c@mail.example.org"), ("a@b and c@d.io", "c@d.io"), ("@x.io", None), ("x" * 5000 + " é@b.co", None), ("..a@b.co", "..a@b.co")])
def test_email(spark, text, wanted):
    assert spark.range(1).select(extract.email(F.lit(text))).first()[0] == wanted


def test_noise_reasons(spark):
    terms = ["C++", "mail me a@b.com", "5 years", "a (b", "one two three four five six", "knowledge of SQL", "Drive alignment", "Kafka and", "very high scale", "Apache Spark", "22 VD DATA 4+Y ONSITE", "Austin TX 78701", "1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(taxonomy.noise_reason(F.col("t"))).collect()]
    assert got == [None, "address", "number", "parentheses", "word_count", "sentence_start", "verb_start", "edge_word", "filler_words", None, "table_row", "state_and_zip", "number"]


def test_match_score_edges(spark):
    schema = "resume struct<skills:array<string>,years_experience:double,work_authorization:string,location:string>, job struct<required_skills:array<string>,preferred_skills:array<string>,years_experience:double,work_authorization:string,location:string>"
    data = [((["Java", "SQL"], 5.0, "H4 EAD", "Austin"), (["java"], [], 5.0, "ead", "remote")), ((None, None, None, None), (["java"], ["x"], 3.0, "gc", "Austin")), ((["a"], 1.0, "opt", "x"), ([], None, 0.0, None, None))]
    got = rows(matching.scored_pairs(spark.createDataFrame(data, schema)).select("required_skill_score", "preferred_skill_score", "years_score", "work_authorization_score", "location_score", "decision"), F.desc("decision"), "years_score")
    assert (100.0, 0.0, 100.0, 100.0, 100.0, "submit") in got
    assert (0.0, 0.0, 50.0, 50.0, 70.0, "reject") in got


def test_transitions(spark):
    steps = spark.createDataFrame([("offer", "placed"), ("placed", "offer"), ("placed", "placed"), ("x", "x")], "a string, b string")
    assert {(r.a, r.b): r.allowed for r in matching.with_allowed(steps, matching.transitions(spark), "a", "b").collect()} == {("offer", "placed"): True, ("placed", "offer"): False, ("placed", "placed"): True, ("x", "x"): False}


def test_parser_ready(spark):
    record = lambda sure, review=False, warn=(): {"requires_review": review, "warnings": list(warn), "parse_confidence": sure}
    parse = lambda *records, kind="hotlist": {"document_kind": kind, "confidence": 0.9, "requires_review": False, "warnings": [], "records": list(records)}
    data = [("ok", parse(record(0.7))), ("low", parse(record(0.69))), ("none", parse()), ("warned", parse(record(0.9, warn=["w"]))), ("kind", parse(record(1.0), kind="x")), ("null", None)]
    df = spark.createDataFrame(data, f"id string, parsing {schemas.PARSING}")
    got = dict(rows(df.select("id", extract.parser_ready(F.lit("hotlist"), F.lit(0.7), F.array())), "id"))
    assert got == {"ok": True, "low": False, "none": False, "warned": False, "kind": False, "null": False}


@pytest.mark.parametrize(("text", "wanted"), [("Two consultants available now", "HOTLIST"), ("Developer is not yet available", "HOTLIST"), ("my resume", "RESUME"), ("hiring now", "JOB"), ("any update", "QUESTION"), ("", "UNKNOWN"), ("engineer" + " " * 25 + "available", "HOTLIST"), ("engineer" + " " * 26 + "available", "UNKNOWN"), ("engineer, and" + "x" * 19 + " available", "HOTLIST"), ("engineer, and" + "x" * 20 + " available", "UNKNOWN")])
def test_intent(spark, text, wanted):
    assert spark.range(1).select(extract.intent(F.lit(text))).first()[0] == wanted


def test_contacts(spark):
    text = "Call: (512) 555-0100 or mobile: +1 512 555 0199\nlinkedin.com/in/ann-b/ H-1B W2 from Austin, TX $65/hr 7+ years ann@x.io"
    got = spark.range(1).select(extract.phone(F.lit(text)), extract.linkedin(F.lit(text)), extract.work_authorization(F.lit(text)), extract.employment_type(F.lit(text)), extract.location(F.lit(text)), extract.years_of_experience(F.lit(text)), extract.email(F.lit(text)), extract.rate(F.lit("$1,065.50/hr"))).first()
    assert tuple(got)[:7] == ("+1 512 555 0199", "https://linkedin.com/in/ann-b", "H1B", "W2", "Austin, TX", 7, "ann@x.io")
    assert tuple(got[7]) == (1065.5, "hour")
    assert spark.range(1).select(extract.e164(F.lit("(512) 555-0100"))).first()[0] == "+15125550100"


def test_sender_precedence(spark):
    forwarded = "---------- Forwarded message ---------\nFrom: Ann <Ann@X.com>\nhi b@y.com"
    pick = lambda text, reply: tuple(spark.range(1).select(extract.sender(F.lit(text), F.lit(reply).cast("string"))).first()[0])
    assert pick(forwarded, "r@z.com") == ("ann@x.com", "forwarded_header", 0.95)
    assert pick("hi b@y.com", "R@z.com")[:2] == ("r@z.com", "reply_to")
    assert pick("hi b@y.com", None)[:2] == ("b@y.com", "body")


def test_hotlist_table(spark):
    text = "Hi\nName | Skill | Visa | Location\nAnn Bee | Java | H1B | TX\nCy Dee | | GC | NJ\nbroken | row\nbye"
    got = rows(parsers.hotlist_table(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text").select("id", "name", "title", "visa", "parse_confidence"), "name")
    assert got == [(1, "Ann Bee", "Java", "H1B", 0.92), (1, "Cy Dee", None, "GC", 0.62)]


def test_positions(spark):
    text = "Hello\nJob Title: Java Dev\nSkills: Java, SQL\nLocation: Austin, TX\nJob Title: QA\n5 years, remote"
    got = rows(parsers.positions(spark.createDataFrame([(1, text), (2, "need someone")], "id int, text string"), "id", "text").select("id", "position", "title", "skills", "years", "location"), "id", "position")
    assert got == [(1, 1, "Java Dev", ["Java", "SQL"], None, "Austin, TX"), (1, 2, "QA", [], 5, "Remote"), (2, 1, None, [], None, None)]


def test_sections_and_key_values(spark):
    text = "Ann\nExperience:\nAcme\nBeta\nEducation\nMIT"
    got = rows(parsers.sections(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text"), "section")
    assert got == [(1, "education", ["MIT"]), (1, "experience", ["Acme", "Beta"]), (1, "header", ["Ann"])]
    pairs = spark.range(1).select(parsers.key_values(F.lit("Role: Dev\nno value\nRole: QA\nPay rate: $5"))).first()[0]
    assert pairs == {"role": "QA", "pay rate": "$5"}


def test_signature(spark):
    text = "Need a dev\nThanks,\nAnn Bee\nTechnical Recruiter\nAcme Solutions Inc\n512-555-0100\nann@acme.io\n\nFrom: x\nRegards,\nOld Name"
    got = parsers.signature(spark.createDataFrame([(1, text), (2, "no sign off")], "id int, text string"), "id", "text").orderBy("id").collect()
    assert (got[0].name, got[0].title, got[0].company, got[0].phone, got[0].email, got[0].confidence) == ("Ann Bee", "Technical Recruiter", "Acme Solutions Inc", "512-555-0100", "ann@acme.io", 0.92)
    assert got[1].confidence == 0.0


def test_boilerplate_never_empties_a_text(spark):
    df = spark.createDataFrame([(1, "Keep\nSent from  my phone"), (2, "sent from my PHONE")], "id int, text string")
    approved = spark.createDataFrame([("sent from my phone",)], "line string")
    assert rows(parsers.without_boilerplate(df, "id", "text", approved), "id") == [(1, "Keep"), (2, "sent from my PHONE")]


def test_language(spark):
    texts = {
        "de": "Wir suchen einen Entwickler für unser Büro in Berlin.", "fr": "Nous avons besoin de vous pour un projet à Lyon.", "es": "Buscamos una persona para la oficina de Madrid.",
        "en": "We are looking for a developer who can start soon.", "unknown": "Lorem ipsum dolor consectetur",
    }
    df = spark.createDataFrame(list(texts.items()), "wanted string, text string")
    assert {r.wanted: r.found for r in df.select("wanted", understanding.language(F.col("text")).alias("found")).collect()} == {k: k for k in texts}
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("der die das",)], "t string").select(understanding.language(F.col("t"))).collect()] == ["unknown"] * 3


def test_language_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and length(trim(text)) >= 200")
    right = docs.select((understanding.language(F.col("text")) == F.col("lang")).cast("double").alias("r")).agg(F.avg("r")).first()[0]
    assert right >= 0.97


def test_an_automaton_reads_a_text_once_for_all_entries(spark):
    texts = spark.createDataFrame([(1, "The C++ of, the of THE end"), (2, None), (3, "often")], "id int, text string")
    entries = spark.createDataFrame([("of the", "of the", "canonical"), ("the of", "x", "alias"), ("the", "x", "alias"), ("c++", "C++", "canonical"), ("", "none", "alias")], "alias string, canonical string, kind string")
    found = taxonomy.found_terms(texts, entries, "id", "text", 2)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "canonical") == [(1, "C++", "canonical", 2, 1), (1, "of the", "canonical", 3, 2), (1, "x", "alias", 1, 4)]

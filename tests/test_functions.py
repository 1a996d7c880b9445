import uuid

import pytest
from pyspark.sql import functions as F

from brookmill.functions import fuzzy, numbers
from brookmill.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "value", "wanted"),
    [
        (X.taxonomy_key, " Node.js / C++ ", "node.js c++"),
        (X.loose_key, "Node.JS C#", "nodejsc#"),
        (X.identity_key, "C ++", "c++"),
        (X.match_text, "Full-Stack_dev  x", "full stack dev x"),
        (X.email_domain, "A@b@Mail.Example.COM", "mail.example.com"),
        (X.email_domain, "nobody", None),
        (X.corporate_domain, "www.Acme.io.", "acme.io"),
        (X.corporate_domain, "mail.google.com", None),
        (X.corporate_domain, "not a domain", None),
        (X.company_name, "  Acme   Inc., ", "Acme Inc."),
        (X.company_name, "1", None),
        (X.company_name, " -Acme Inc | Dallas", "Acme Inc"),
        (X.company_name, "Acme, 1200 Main St", "Acme"),
        (X.company_name, "Location: Dallas", None),
        (X.company_name, "Fromage Inc", "Fromage Inc"),
        (X.company_name, "Client", None),
        (X.url_host, "https://u@Sub.Example.com:80/x?y", "sub.example.com"),
        (X.clean_url, "https://a.com/x/?q=1#t", "https://a.com/x"),
        (X.clean_url, "ftp://a.com", None),
        (X.strip_html, "<p>a&amp;b</p><br/>c<i>d</i>", "a&b\n\nc d"),
        (X.strip_html, None, ""),
        (X.strip_html, "a &amp;amp b &amp c &quo &copyx; &#65 &am", "a &amp b &amp c &quo &copyx; &#65 &am"),
        (X.strip_html, "it&rsquo;s &#8364;5 &#x41;<br>&nbsp;x&nbsp;", "it’s €5 A\n\u00a0x"),
        (X.split_list, "a, b;;c ", ["a", "b", "c"]),
        (X.addresses, "Ann <A@x.com>; b@y.org, a@x.com", ["a@x.com", "b@y.org"]),
        (X.base64url, "aMOpPz8_", "hé???"),
        (lambda c: X.labelled_value(c, "Location"), "x\n Location - Austin, TX \ny", "Austin, TX"),
        (lambda c: X.labelled_section(c, ("Required Skills",), ("Location",)), "Required Skills: a\nb\nLocation: c", "a\nb"),
        (lambda c: X.within_budget(c, 4, 0.5), "a b c d e f", "a b ... e f"),
        (numbers.first_integer, "about 12 years", 12),
        (numbers.first_integer, "90 days", None),
    ],
)
def test_text_function(spark, function, value, wanted):
    assert one(spark, function(F.lit(value).cast("string"))) == wanted


def test_phrase_needs_its_own_bounds(spark):
    has = lambda text, phrase: one(spark, X.has_phrase(F.lit(text), F.lit(phrase)))
    assert has("We use C++ here", "c++") and has("java", "Java")
    assert not has("javascript", "java")


def test_like_signs_stand_for_themselves(spark):
    assert one(spark, X.has_literal(F.lit("50%_off\\now"), "%_OFF\\"))
    assert not one(spark, X.has_literal(F.lit("50 off"), "%"))


def test_uuid5_and_hashes(spark):
    assert one(spark, X.uuid5(str(uuid.NAMESPACE_DNS), F.lit("python"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "python"))
    assert one(spark, X.body_hash(F.lit(None).cast("string"))) == one(spark, F.sha2(F.lit(""), 256))


def test_name_parts(spark):
    assert tuple(one(spark, X.name_parts(F.lit("Ann B. C. Dee")))) == ("Ann", "B. C.", "Dee")
    assert tuple(one(spark, X.name_parts(F.lit("Ann")))) == ("Ann", None, None)


def test_rendered(spark):
    assert one(spark, X.rendered("Hi {{name}}, {{n}}", {"name": F.lit("Bo"), "n": F.lit(None).cast("int")})) == "Hi Bo, "


def test_indel_ratio(spark):
    assert fuzzy.indel_ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    assert fuzzy.indel_ratio("", "") == 100 and fuzzy.indel_ratio("a", "") == 0
    df = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.ratio("a", "b")).collect()] == [pytest.approx(100 * 4 / 6), None]

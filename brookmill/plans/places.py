"""Places of terms, nested mail and boilerplate, over texts that vary with each row of the driver's tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.operators import places, upkeep
from brookmill.sources import messages
from brookmill.sources.tables import table

from .registry import query

_TEXT = "repeat('é', CAST(c_custkey % 7 AS INT)) || lower(c_mktsegment) || '/' || n_name || ' x' || n_name || '; ' || lower(n_name) || CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_mktsegment ELSE 'q' END"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return customers.select("c_custkey", F.expr(_TEXT).alias("text"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("canonical"), F.lit("canonical").alias("kind"))
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return nations.unionByName(segments.select(F.initcap("c_mktsegment").alias("alias"), F.concat(F.lit("Market "), "c_mktsegment").alias("canonical"), F.lit("alias").alias("kind")))


_PLACES = f"""
WITH t AS (SELECT c_custkey, n_name, c_mktsegment AS m, c_custkey % 7 AS k, {_TEXT} AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (
    SELECT c_custkey, text, 'Market ' || m AS canonical, 'alias' AS kind, k AS b, length(m) AS n FROM t
    UNION ALL SELECT c_custkey, text, n_name, 'canonical', k + length(m) + 1, length(n_name) FROM t
    UNION ALL SELECT c_custkey, text, n_name, 'canonical', k + length(m) + 1 + length(n_name) + 2 + length(n_name) + 2, length(n_name) FROM t WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, text, 'Market ' || m, 'alias', length(text) - length(m), length(m) FROM t WHERE c_custkey % 3 = 0)"""


@query(f"""{_PLACES}
SELECT c_custkey, substr(text, CAST(b + 1 AS INT), n) AS raw_text, canonical, kind, CAST(b AS INT) AS "start", CAST(b + n AS INT) AS "end" FROM p""")
def term_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of nations and markets, in any case, beside letters of other scripts and within words."""
    return places.term_places(_texts(spark, sf_dir), _names(spark, sf_dir), "c_custkey", "text")


@query(f"""{_PLACES}
SELECT c_custkey, canonical, CAST(min(b) AS INT) AS "start" FROM p GROUP BY 1, 2""")
def first_term_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place of each name in a text, with a dictionary in several blocks."""
    found = places.term_places(_texts(spark, sf_dir), _names(spark, sf_dir), "c_custkey", "text", block=7)
    return places.best_places(found, "c_custkey").select("c_custkey", "canonical", "start")


@query("""
SELECT 'g' || c_custkey AS source_message_id, 'c' || c_custkey || '@mill.io' AS sender_email, CASE c_custkey % 7
    WHEN 0 THEN c_name WHEN 1 THEN c_name || ' pays ' || c_acctbal::DECIMAL(18,2) WHEN 2 THEN c_name WHEN 3 THEN '<p>' || c_name || '</p>' WHEN 4 THEN '<b>' || c_mktsegment || '</b>' WHEN 5 THEN 'snippet of ' || c_name ELSE c_mktsegment END AS text
FROM customer""")
def nested_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of mails whose MIME trees are one to four levels deep, plain, HTML alone, empty, or with attachments first."""
    data = lambda x: F.translate(F.base64(F.encode(x, "UTF-8")), "+/=\r\n", "-_")
    name, market = F.col("c_name"), F.col("c_mktsegment")
    tagged = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))

    def part(kind: str, x: Column | None = None, *below: Column) -> Column:
        body = F.concat(F.lit('{"data":"'), data(x), F.lit('"}')) if x is not None else F.lit('{"size":0}')
        return F.concat(F.lit(f'{{"mimeType":"{kind}","body":'), body, F.lit(',"parts":['), F.concat_ws(",", *below), F.lit("]}"))

    plain, html = (lambda x: part("text/plain", x)), (lambda x: part("text/html", x))
    both = part("multipart/alternative", None, html(tagged("p", name)), plain(F.concat(name, F.lit(" pays "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))))
    attached = part("application/pdf")
    trees = [
        plain(name),
        part("multipart/mixed", None, both, attached),
        part("multipart/mixed", None, attached, part("multipart/related", None, part("multipart/alternative", None, html(market), plain(name)))),
        part("multipart/mixed", None, part("multipart/alternative", None, plain(F.lit("")), html(tagged("p", name)))),
        html(tagged("b", market)),
        part("multipart/mixed", None, attached, part("multipart/mixed", None)),
        part("multipart/mixed", None, part("multipart/alternative", None, html(name), plain(name)), plain(market)),
    ]
    k = F.col("c_custkey") % len(trees)
    tree = F.coalesce(*[F.when(k == i, t) for i, t in enumerate(trees)])
    sender = F.concat(F.lit('"headers":[{"name":"From","value":"<C'), "c_custkey", F.lit('@Mill.io>"}],'))
    payload = F.concat(F.lit('{"id":"g'), "c_custkey", F.lit('","snippet":"snippet of '), name, F.lit('","payload":{'), sender, F.substring(tree, F.lit(2), F.length(tree)), F.lit("}"))
    return messages.gmail(table(spark, sf_dir, "customer").select(payload.alias("payload"))).select("source_message_id", "sender_email", "text")


@query("""
SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN CASE WHEN o_custkey % 20 <= 9 THEN 'approve' ELSE 'review' END
    WHEN 1 THEN 'reject' WHEN 2 THEN CASE WHEN 40 + o_custkey % 200 <= 140 THEN 'approve' ELSE 'review' END
    WHEN 3 THEN 'approve' WHEN 4 THEN CASE WHEN 20 + o_custkey % 300 > 220 THEN 'reject' ELSE 'review' END
    WHEN 5 THEN 'approve' WHEN 6 THEN CASE WHEN o_custkey % 2 = 0 THEN 'reject' ELSE 'review' END
    ELSE 'approve' END AS decision FROM orders""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines judged as boilerplate, about the lengths where the verdict turns, with case and spacing of their own."""
    n = F.col("o_custkey")
    repeated = lambda x, times: F.expr(f"repeat('{x}', cast({times} as int))")
    headings = F.array(*[F.lit(h) for h in upkeep.BOILERPLATE_HEADINGS])
    lines = [
        F.concat(F.lit("EQUAL  opportunity "), repeated("x", "170 + o_custkey % 20")),
        F.concat(F.lit("wants "), n, F.lit("+ Years, "), F.col("o_orderpriority")),
        F.concat(F.lit("To apply, please share"), repeated("y", "40 + o_custkey % 200"), F.lit("CV")),
        F.concat(F.lit(" "), F.initcap(F.get(headings, (n % F.size(headings)).cast("int"))), F.lit(" :")),
        repeated("z", "20 + o_custkey % 300"),
        F.concat(F.lit("This message of "), F.col("o_clerk"), F.lit(" is Confidential")),
        F.concat(F.when(n % 2 == 0, "- ").otherwise("-"), F.lit("item "), F.lit("of the list")),
        F.concat(F.when(n % 2 == 0, "Strong ").otherwise("excellent "), F.when(n % 3 == 0, "written and verbal ").otherwise(""), F.lit("Communication and problem solving skills.")),
    ]
    line = F.coalesce(*[F.when(F.col("o_orderkey") % len(lines) == i, x) for i, x in enumerate(lines)])
    return table(spark, sf_dir, "orders").select("o_orderkey", upkeep.boilerplate_decision(line).alias("decision"))

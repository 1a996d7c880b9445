"""Signatures read out of mails whose layout, order of lines, spelling and line ends vary with each customer."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.operators import signatures
from brookmill.sources.tables import spread, table

from .registry import query

FIRST, LAST = ("Ann", "Bo", "Cy-Lee", "O'Dell", "Eve"), ("Bee", "Ng", "St. Clair", "McRae", "Ito", "Vance", "Diaz")
TITLES, KINDS = ("Lead Recruiter", "Senior Account Manager", "talent sourcer", "Director of Delivery"), ("Inc", "LLC", "Systems", "Group")
OFFS = ("Best regards,", "Thanks", "--", "KIND REGARDS", "  Thank you!", "Thanks and regards,", "Cheers.", "Sincerely,")
NUMBERS, LABELS = ("(214) 555-", "214.555.", "+1 214 555 "), ("M: ", "Office: ", "cell - ", "")


def _picked(values: tuple[str, ...], by: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), by.cast("int") % len(values))


def _sql(values: tuple[str, ...], by: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][CAST({by} AS INT) % {len(values)} + 1]"


def _mails(customers: DataFrame) -> DataFrame:
    k, c = F.col("c_custkey"), F.col("c_nationkey")
    first, name, email, company, title, own = (F.col(x) for x in ("first", "name", "email", "company", "title", "own"))
    phone = F.concat(_picked(LABELS, c), _picked(NUMBERS, k), F.lpad((k % 10000).cast("string"), 4, "0"))
    made = customers.select("c_custkey", "c_nationkey", _picked(FIRST, k).alias("first"), _picked(LAST, c).alias("last"), F.concat(F.lit("Desk"), c, F.lit("@Mill.IO")).alias("email"), F.concat(F.lit("Mill"), c, F.lit(" "), _picked(KINDS, k)).alias("company"), _picked(TITLES, c).alias("title"), phone.alias("phone"))
    parts = F.array(F.when(c % 3 != 0, title), F.when(c % 5 != 0, company), F.when(c % 4 != 0, email), F.when(k % 3 != 0, F.col("phone")))
    made = made.withColumns({"name": F.concat_ws(" ", "first", "last"), "parts": parts, "turn": (k % 4).cast("int")})
    turned = F.array_compact(F.concat(F.slice("parts", F.col("turn") + 1, F.lit(4)), F.slice("parts", F.lit(1), F.col("turn"))))
    made = made.withColumn("own", F.concat_ws("\n", F.lit("We look for a miller.\n"), _picked(OFFS, k + c), name, turned))
    quoted = F.concat(own, F.lit("\n\nOn Monday, Old Hand wrote:\n> Regards,\n> Old Hand\n> Director\n> old@hand.io"))
    legal = F.concat(own, F.lit("\n\nThis message is confidential.\nOther Systems Inc\nother@hand.io\n"))
    layouts = [
        F.when(c % 2 == 0, own).otherwise(legal),
        quoted,
        F.concat_ws("\n", F.lit("We have a role.\n"), name, F.when(c % 2 == 0, ""), title, email),
        F.concat_ws("\n", F.lit("FW: note\nFrom: Ox <ox@hand.io>\nSent: Monday\nSubject: role\n"), company, email, F.repeat(F.lit("we need someone soon\n"), 20)),
        F.concat(F.lit("fine for order "), k, F.lit("\n\nSent from my iPhone\n")),
        F.concat_ws("\n", F.concat(F.lit("Role "), k), F.lit("From :"), F.concat(first, F.lit(",")), F.lower(F.concat(F.lit("Mill"), c)), email, F.lit("Reply to: none\n")),
        F.concat(F.lit("order "), k, F.lit(" is on its way")),
    ]
    made = made.withColumn("text", F.coalesce(*[F.when(k % 7 == i, x) for i, x in enumerate(layouts)]))
    return made.select("c_custkey", F.when(c % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")).alias("text"))


@query(f"""
WITH t AS (SELECT c_custkey AS k, c_nationkey AS c, c_custkey % 7 AS l, {_sql(FIRST, 'c_custkey')} AS f, {_sql(FIRST, 'c_custkey')} || ' ' || {_sql(LAST, 'c_nationkey')} AS n, {_sql(TITLES, 'c_nationkey')} AS t, 'Mill' || c_nationkey || ' ' || {_sql(KINDS, 'c_custkey')} AS co, 'desk' || c_nationkey || '@mill.io' AS e, '+1214555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS p FROM customer),
r AS (SELECT k, CASE WHEN l <= 1 THEN 'signoff_marker' WHEN l <= 3 THEN 'structural' WHEN l = 4 THEN 'mobile_signature_marker' WHEN l = 5 THEN 'relay_from_block' END AS method,
    CASE WHEN l <= 2 THEN n WHEN l = 5 THEN f END AS name,
    CASE WHEN (l <= 1 AND c % 3 != 0) OR l = 2 THEN t END AS title,
    CASE WHEN (l <= 1 AND c % 5 != 0) OR l = 3 THEN co WHEN l = 5 THEN 'mill' || c END AS company,
    CASE WHEN (l <= 1 AND c % 4 != 0) OR l IN (2, 3, 5) THEN e END AS email,
    CASE WHEN l <= 1 AND k % 3 != 0 AND c % 4 IN (1, 3) THEN p END AS phone,
    CASE WHEN l <= 1 AND k % 3 != 0 AND c % 4 IN (0, 2) THEN p END AS mobile,
    l = 1 AS quoted_ignored, l = 0 AND c % 2 = 1 AS disclaimer FROM t)
SELECT k AS c_custkey, method, name, title, company, email, phone, mobile, quoted_ignored, disclaimer,
[0.0, 0.45, 0.70, 0.92][1 + (name IS NOT NULL)::INT + (email IS NOT NULL OR phone IS NOT NULL OR mobile IS NOT NULL)::INT + (title IS NOT NULL OR company IS NOT NULL)::INT]::DOUBLE AS confidence FROM r""")
def mail_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures below sign-offs, above quoted mail and disclaimers, of forwards, of relays, without a sign-off, and of devices."""
    found = signatures.signatures(_mails(spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))), "text")
    value = lambda k: F.col(f"signature.contact.{k}.value").alias(k)
    return found.select(
        "c_custkey", "signature.method", *[value(k) for k in ("name", "title", "company", "email", "phone", "mobile")], "signature.quoted_ignored",
        F.array_contains("signature.warnings", "disclaimer_removed").alias("disclaimer"), F.col("signature.confidence").cast("double").alias("confidence"),
    )

"""Hotlists and requirements read out of mails whose layout, order, spelling and gaps vary with each customer."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.operators import mails
from brookmill.sources.tables import spread, table

from .registry import query
from .signatures import FIRST, LAST, _picked, _sql

ROLES, SKILLS = ("Backend Developer", "QA Analyst", "Data Architect", "Release Engineer"), ("Java, AWS", "SQL", "Python, Docker", "Kubernetes")


def _mails(customers: DataFrame) -> DataFrame:
    k, c = F.col("c_custkey"), F.col("c_nationkey")
    name = lambda i: F.concat_ws(" ", _picked(FIRST, k + i), _picked(LAST, c + i))
    role, skills = (lambda values: lambda i: _picked(values, c + i))(ROLES), (lambda values: lambda i: _picked(values, k + i))(SKILLS)
    years = lambda i: (((k + i) % 30) + 1).cast("string")
    known = lambda i, x: F.when((k + i) % 3 != 0, x).otherwise("")
    company = F.when(c % 5 != 0, F.concat(F.lit("End Client: Acme "), k, F.lit("\n"))).otherwise("")

    def grid(by: str) -> Column:
        one = lambda i: F.concat_ws(by, name(i), known(i, role(i)), F.lit("H1B"), known(i, skills(i)), F.concat(years(i), F.lit(" yrs")))
        other = lambda i: F.concat_ws(by, known(i, skills(i)), F.concat(years(i), F.lit("+")), name(i), known(i, role(i)), F.lit("H1B"))
        first = F.concat_ws("\n", F.lit(f"Hi all{'' if by.strip() else ' | of you'}\n"), F.lit(by.join(("Consultant Name", "Title", "VISA status", "Skills", "Exp."))), one(1), one(2), F.lit("Bye"))
        second = F.concat_ws("\n", F.lit(f"Hi all{'' if by.strip() else ' | of you'}\n"), F.lit(by.join(("Primary Skills", "Total Experience", "Resource", "Technology", "Work Auth"))), other(1), other(2), F.lit("Bye"))
        return F.when(c % 2 == 0, first).otherwise(second)

    block = lambda i: F.concat_ws("\n", F.concat(F.lit("Name: "), name(i)), F.concat(F.lit("Role: "), role(i)), F.concat(years(i), F.lit("+ years of "), skills(i), F.lit(", H1B")), F.lit("Austin, TX"))
    tight = lambda i: F.concat_ws("\n", F.concat(F.lit("CANDIDATE - "), name(i)), F.concat(F.lit("Title: "), role(i)), F.concat(years(i), F.lit(" years with "), skills(i)))
    labelled = F.concat(F.lit("From: x\n\nJob Title: "), role(1), F.lit("\nRequired Skills: "), skills(1), F.lit("\n"), years(1), F.lit(" years\nPosition - "), role(2), F.lit("\n"), company, F.lit("needs "), skills(2), F.lit(" in a text that is long enough\nRegards,\nOx\nRole: Senior Manager"))
    numbered = F.concat(F.lit("We hire\n1) "), role(1), F.lit("\nClient: Acme "), k, F.lit("\n"), skills(1), F.lit(" needed, "), years(1), F.lit("+ years, remote work\n2) "), role(2), F.lit("\nlong enough words about "), skills(2), F.lit(" that count\nKeywords: Senior Tester"))
    layouts = [grid(" | "), grid("\t"), F.concat(F.lit("Hi,\n\n"), block(1), F.when(c % 2 == 0, "\n\n").otherwise("\n \n"), block(2), F.lit("\n\nBye")), F.concat_ws("\n", F.lit("My list:"), tight(1), tight(2), tight(3)), labelled, numbered, F.lit("order on its way")]
    text = F.coalesce(*[F.when(k % 7 == i, x) for i, x in enumerate(layouts)])
    kind = F.when(k % 7 <= 3, "hotlist").when(k % 7 <= 5, "job_description").otherwise("note")
    return customers.select("c_custkey", kind.alias("kind"), F.when(c % 3 == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text).alias("text"))


@query(f"""
WITH t AS (SELECT c_custkey AS k, c_nationkey AS c, c_custkey % 7 AS l, unnest([1, 2, 3]) AS i FROM customer),
v AS (SELECT *, {_sql(FIRST, 'k + i')} || ' ' || {_sql(LAST, 'c + i')} AS n, {_sql(ROLES, 'c + i')} AS r, {_sql(SKILLS, 'k + i')} AS s, (k + i) % 30 + 1 AS y FROM t WHERE l != 6 AND (i < 3 OR l = 3)),
w AS (SELECT k AS c_custkey, CASE WHEN l <= 3 THEN 'hotlist' ELSE 'job_description' END AS kind, CASE WHEN l = 3 THEN 3 ELSE 2 END AS n_records, CAST(CASE WHEN l <= 1 THEN i + 2 ELSE i END AS VARCHAR) AS source,
    CASE WHEN l <= 3 THEN n END AS name, CASE WHEN l >= 2 OR (k + i) % 3 != 0 THEN r END AS title, CASE WHEN l = 5 OR (l = 4 AND c % 5 != 0) THEN 'Acme ' || k END AS company,
    CASE WHEN l >= 2 OR (k + i) % 3 != 0 THEN replace(s, ', ', ',') ELSE '' END AS skills, CAST(CASE WHEN l <= 3 OR i = 1 THEN y END AS VARCHAR) AS years,
    CASE l WHEN 2 THEN 'Austin, TX' WHEN 5 THEN 'Remote' END AS location, CASE WHEN l <= 2 THEN 'H1B' END AS work_authorization,
    CASE WHEN l <= 1 AND (k + i) % 3 = 0 THEN 0.62 WHEN l = 4 AND c % 5 = 0 THEN 0.65 ELSE 0.92 END::DOUBLE AS confidence FROM v)
SELECT *, CASE WHEN confidence = 0.62 THEN 'candidate_title_or_skills_missing' WHEN confidence = 0.65 THEN 'company_missing' ELSE '' END AS warnings FROM w
UNION ALL SELECT c_custkey, 'note', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unsupported_email_document_kind' FROM customer WHERE c_custkey % 7 = 6""")
def mail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consultants of tables, of blocks and of labels that repeat, and positions at labels and numbers; a kind without a parser."""
    found = _mails(spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))).withColumn("m", mails.business_records(F.col("text"), F.col("kind")))
    none, shown = F.lit(None).cast("string"), ("source", "skills", "years", "location", "work_authorization", "parse_confidence", "warnings")
    alike = lambda title, name, company: lambda r: F.struct(name(r).alias("name"), r[title].alias("title"), company(r).alias("company"), *[r[f].alias(f) for f in shown])
    consultants = F.transform("m.consultants", alike("title", lambda r: r["name"], lambda r: none))
    positions = F.transform("m.positions", alike("job_title", lambda r: none, lambda r: r["company"]))
    rows = found.select("c_custkey", "kind", "m", F.explode_outer(F.concat(consultants, positions)).alias("r"))
    return rows.select(
        "c_custkey", "kind", F.col("m.record_count").alias("n_records"), F.col("r.source").cast("string").alias("source"), "r.name", "r.title", "r.company", F.array_join("r.skills", ",").alias("skills"), F.col("r.years").cast("string").alias("years"), "r.location", "r.work_authorization",
        F.col("r.parse_confidence").alias("confidence"), F.array_join(F.coalesce("r.warnings", "m.warnings"), ",").alias("warnings"),
    )

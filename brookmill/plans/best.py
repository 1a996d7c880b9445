"""The best parts for each supplier, as jobs and resumes that spell their skills in ways of their own."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.operators import best, taxonomy
from brookmill.sources.tables import table

from .registry import query


@query("""
WITH j AS (SELECT p_partkey AS job_id, list_distinct(string_split(lower(p_name), ' ') || [lower(p_type)]) AS req, lower(p_brand) AS pref, p_size % 30 AS want, [NULL, 'h1b', 'green card'][p_size % 3 + 1] AS auth, ['dallas, tx', 'remote', NULL, 'austin, tx'][p_partkey % 4 + 1] AS place FROM part),
r AS (SELECT s_suppkey AS resume_id, flatten(list(string_split(lower(p_name), ' ') || [lower(p_type), lower(p_brand)])) AS skills, CASE WHEN s_suppkey % 11 != 0 THEN s_suppkey % 25 END AS have, ['h1b', 'green card', 'us citizen', NULL][s_suppkey % 4 + 1] AS auth, ['dallas, tx', NULL, 'austin, tx'][s_suppkey % 3 + 1] AS place
    FROM supplier JOIN part ON p_partkey IN (s_suppkey, s_suppkey + 1, 2 * s_suppkey + 1) GROUP BY s_suppkey),
s AS (SELECT resume_id, job_id, round_even(100.0::DOUBLE * len(list_intersect(req, skills)) / len(req), 2) AS a, CASE WHEN list_contains(skills, pref) THEN 100.0 ELSE 0 END::DOUBLE AS b,
    CASE WHEN want = 0 THEN 100 WHEN have IS NULL THEN 50 WHEN have >= want THEN 100 ELSE round_even(100.0::DOUBLE * have / want, 2) END::DOUBLE AS y,
    CASE WHEN j.auth IS NULL THEN 100 WHEN r.auth IS NULL THEN 50 WHEN r.auth = j.auth THEN 100 ELSE 0 END::DOUBLE AS w,
    CASE WHEN j.place IS NULL THEN 100 WHEN r.place IS NULL THEN 70 WHEN j.place = 'remote' OR j.place = r.place THEN 100 ELSE 60 END::DOUBLE AS l,
    array_to_string(list_sort(list_filter(req, lambda x: NOT list_contains(skills, x))), ',') AS missing FROM r, j WHERE len(list_intersect(req, skills)) >= ceil(len(req) * 0.6 - 1e-9)),
m AS (SELECT *, round_even(a * 0.55::DOUBLE + b * 0.15::DOUBLE + y * 0.15::DOUBLE + w * 0.1::DOUBLE + l * 0.05::DOUBLE, 2) AS match_score FROM s),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, job_id) AS INT) AS rank FROM m)
SELECT resume_id, rank, job_id, match_score, CASE WHEN match_score >= 80 AND a >= 100 AND y >= 80 AND w > 0 THEN 'submit' WHEN match_score >= 60 AND a >= 60 AND w > 0 THEN 'review' ELSE 'reject' END AS decision, missing FROM n WHERE rank <= 10""")
def best_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best parts of each supplier: what it supplies as skills, by aliases, against a part's name, type and brand."""
    part = table(spark, sf_dir, "part")
    place = lambda names, key: F.get(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names)).cast("int"))
    words = F.split(F.initcap("p_name"), " ")
    jobs = part.select(
        F.col("p_partkey").alias("job_id"), F.concat(words, F.array("p_type")).alias("required_skills"), F.array(F.concat(F.lit(" "), "p_brand")).alias("preferred_skills"), (F.col("p_size") % 30).cast("double").alias("years_experience"),
        place((None, "H1B", "Green Card"), "p_size").alias("work_authorization"), place(("Dallas, TX", "Remote", None, "Austin, TX"), "p_partkey").alias("location"),
    )
    supplied = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.col("s_suppkey"), F.col("s_suppkey") + 1, 2 * F.col("s_suppkey") + 1)).alias("p_partkey")).distinct()
    own = F.concat(F.transform(words, lambda w: F.concat(w, F.lit("  "))), F.array(F.concat(F.lit("Kind_of "), F.lower("p_type")), "p_brand"))
    resumes = supplied.join(part, "p_partkey").groupBy("s_suppkey").agg(F.flatten(F.collect_list(own)).alias("skills")).select(
        F.col("s_suppkey").alias("resume_id"), "skills", F.when(F.col("s_suppkey") % 11 != 0, (F.col("s_suppkey") % 25).cast("double")).alias("years_experience"),
        place(("h-1b", "GC", "USC", None), "s_suppkey").alias("work_authorization"), place(("Dallas, TX", None, "Austin, TX"), "s_suppkey").alias("location"),
    )
    names = part.select(F.col("p_type").alias("canonical")).distinct().withColumn("aliases", F.array(F.concat(F.lit("kind of "), "canonical")))
    found = best.best_jobs(resumes, jobs, taxonomy.alias_index(names))
    return found.select("resume_id", "rank", "job_id", "match_score", "decision", F.array_join(F.array_sort(F.transform("missing_required", lambda s: F.lower(s))), ",").alias("missing"))

"""Names of companies after new, edited and deleted drafts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.operators import projection
from brookmill.sources.tables import table

from .registry import query


def _observed(drafts: DataFrame) -> DataFrame:
    method = F.when(F.col("status") == "F", "human_edited").when(F.col("status") == "P", "signature").otherwise("sender_domain")
    return drafts.select("draft_id", "domain", "label", method.alias("method"), "observed_at", F.when(F.col("domain").isNull(), "none").otherwise("linked").alias("reason"))


@query("""
WITH d AS (SELECT 'c' || (o_custkey % 60) || '.io' AS domain, o_orderpriority || ' ' || (o_orderkey % 3) AS label, o_orderstatus = 'F' AS corrected, o_orderstatus != 'O' AS own, o_orderdate AS seen_at FROM orders WHERE o_orderkey % 13 != 0),
l AS (SELECT domain, label, max(corrected) AS corrected, max(own) AS own, count(*) AS n, max(seen_at) AS seen_at FROM d GROUP BY 1, 2),
r AS (SELECT domain, label AS name, row_number() OVER (PARTITION BY domain ORDER BY corrected DESC, own DESC, n DESC, seen_at DESC, label) AS k, CAST(sum(n) OVER (PARTITION BY domain) AS BIGINT) AS drafts FROM l)
SELECT domain, name, drafts FROM r WHERE k = 1""")
def company_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts. At first a fifth is missing, a seventh says otherwise and some are there that go; then only what changed is looked at again."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    domain = F.when(k % 13 != 0, F.concat(F.lit("c"), F.col("o_custkey") % 60, F.lit(".io")))
    after = orders.select(k.alias("draft_id"), domain.alias("domain"), F.concat_ws(" ", "o_orderpriority", k % 3).alias("label"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("observed_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    d = F.col("draft_id")
    edited = after.where(d % 5 != 0).withColumns({"domain": F.when(d % 7 == 0, F.concat(F.lit("c"), d % 60, F.lit(".io"))).otherwise(F.col("domain")), "updated_at": F.when(d % 7 == 0, F.lit("2023-01-01").cast("timestamp")).otherwise(F.col("updated_at"))})
    gone = after.where(d % 11 == 0).withColumns({"draft_id": -d - 1, "label": F.lit("Gone"), "status": F.lit("F")})
    first = projection.step(edited.unionByName(gone), projection.empty(spark), _observed, "1")
    second = projection.step(after, first, _observed, "1")
    counts = second.observations.groupBy("domain").agg(F.count("*").alias("drafts"))
    return second.companies.join(counts, "domain").select("domain", "name", "drafts")

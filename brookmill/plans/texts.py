"""Text queries over documents, pages, parts and conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions import text as X
from brookmill.operators import extract, taxonomy
from brookmill.sources.tables import table

from .registry import query

# A small dictionary of phrases (alias, canonical, kind).
DICTIONARY = (("of the", "of the", "canonical"), ("of a", "of the", "alias"), ("and the", "and the", "canonical"), ("in the", "in the", "canonical"), ("de la", "de la", "canonical"), ("et la", "de la", "alias"))
_KEY = "trim(regexp_replace(lower(text), '[^a-z0-9+#.]+', ' ', 'g'))"
_WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w != '')"


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9+#.]+', ' ', 'g')) AS taxonomy_key, regexp_replace(lower(p_brand), '[^a-z0-9+#]', '', 'g') AS loose_key, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS header_key, trim(regexp_replace(lower(translate(p_name, '_-', '  ')), '\\s+', ' ', 'g')) AS match_text FROM part")
def term_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.taxonomy_key(F.col("p_name")).alias("taxonomy_key"), X.loose_key(F.col("p_brand")).alias("loose_key"), X.header_key(F.col("p_brand")).alias("header_key"), X.match_text(F.col("p_name")).alias("match_text"))


@query(r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '</?(?:br|p|div|tr|li|h[1-6]|table)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS a FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(a, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS a FROM t)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS text FROM u""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query(r"""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, CASE WHEN regexp_matches(url, '^https?://') AND host != '' THEN regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') END AS clean_url, CASE WHEN regexp_matches(host, '^(www[.])?[a-z0-9]([a-z0-9.-]*[a-z0-9])?[.][a-z]{2,}$') THEN regexp_replace(host, '^www[.]', '') END AS company FROM h""")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("host", X.url_host(F.col("url")))
    return pages.select("page_id", "host", X.clean_url(F.col("url")).alias("clean_url"), X.corporate_domain(F.col("host")).alias("company"))


@query(rf"""
WITH q AS (SELECT doc_id, length(trim(text)) AS chars, len({_WORDS}) AS words, NOT regexp_matches(text, '\p{{L}}') AS bare FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN chars < 40 THEN 'text_too_short' END, CASE WHEN words < 5 THEN 'too_few_words' END, CASE WHEN bare THEN 'no_alpha_text' END, CASE WHEN chars < 20 THEN 'language_unknown' END], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN chars < 40 OR bare THEN 0.35 WHEN words < 5 OR chars < 20 THEN 0.55 ELSE 0.9 END::DOUBLE AS confidence FROM q""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", extract.text_quality(F.col("text")).alias("q"))
    return found.select("doc_id", F.array_join("q.reasons", ",").alias("reasons"), F.col("q.confidence").cast("double").alias("confidence"))


def _contains(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(low, '{w}')" for w in words)


@query(f"""
WITH t AS (SELECT doc_id, lower(text) AS low FROM documents),
i AS (SELECT doc_id, CASE WHEN {_contains(extract.HOTLIST_WORDS)} OR regexp_matches(low, '(^|[^a-z0-9_])(developer|engineer|consultant|candidate|resources?|profiles?)([^a-z0-9_.][^.]{{0,23}}|)[^a-z0-9_.]available([^a-z0-9_]|$)') THEN 'HOTLIST' WHEN {_contains(extract.RESUME_WORDS)} THEN 'RESUME' WHEN {_contains(extract.JOB_WORDS)} THEN 'JOB' WHEN {_contains(extract.QUESTION_WORDS)} THEN 'QUESTION' ELSE 'UNKNOWN' END AS intent FROM t)
SELECT doc_id, intent, CASE intent WHEN 'HOTLIST' THEN 0.85 WHEN 'RESUME' THEN 0.80 WHEN 'JOB' THEN 0.90 WHEN 'QUESTION' THEN 0.70 ELSE 0.40 END::DOUBLE AS confidence FROM i""")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = extract.intent(F.col("text"))
    found = table(spark, sf_dir, "documents").select("doc_id", kind.alias("intent"))
    return found.withColumn("confidence", extract.intent_confidence(F.col("intent")).cast("double"))


@query(f"""
WITH t AS (SELECT doc_id, length(trim(text)) AS chars, lower(trim(text)) AS low FROM documents),
m AS (SELECT *, {" + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in extract.MARKETING_MARKERS)} AS hits, regexp_matches(low, '(^|[^a-z0-9_])(?:{"|".join(extract.JOB_MARKERS)})([^a-z0-9_]|$)') AS job FROM t)
SELECT doc_id, CASE WHEN chars < 25 THEN 'empty_or_near_empty_content' WHEN hits >= 2 AND NOT job THEN 'no_hotlist_or_requirement_signal,marketing_footer_markers_without_job_content' ELSE 'no_hotlist_or_requirement_signal' END AS reasons FROM m""")
def spam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged as an unknown kind of message with no confidence."""
    reasons = extract.spam_reasons(F.col("text"), F.lit("unknown"), F.lit(0.0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(reasons, ",").alias("reasons"))


@query(rf"""
SELECT doc_id, nullif(regexp_extract(text, '{extract.EMAIL}', 0), '') AS email, nullif(regexp_extract(text, '{extract.PHONE}', 0), '') AS phone_pattern,
nullif(regexp_extract(lower(text), '([0-9]{{1,2}})\+?[ \t]*(?:years|yrs|year)', 1), '')::INT::VARCHAR AS years,
CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(?:remote)([^a-z0-9_]|$)') THEN true ELSE false END AS remote FROM documents""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", extract.email(text).alias("email"), F.nullif(F.regexp_extract(text, extract.PHONE, 0), F.lit("")).alias("phone_pattern"), extract.years_of_experience(text).cast("string").alias("years"), (F.coalesce(extract.location(text), F.lit("")) == "Remote").alias("remote"))


@query(f"""
WITH k AS (SELECT doc_id, ' ' || {_KEY} || ' ' AS k FROM documents), d(phrase, canonical, kind) AS (VALUES {", ".join(str(x) for x in DICTIONARY)})
SELECT doc_id, canonical, CASE WHEN bool_or(kind = 'canonical') THEN 'canonical' ELSE 'alias' END AS kind FROM k JOIN d ON contains(k, ' ' || phrase || ' ') GROUP BY 1, 2""")
def taxonomy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary phrases in documents, by a join of word runs with the dictionary's keys."""
    dictionary = spark.createDataFrame(list(DICTIONARY), "alias string, canonical string, kind string")
    return taxonomy.found_terms(table(spark, sf_dir, "documents"), dictionary, "doc_id", "text", 2).select("doc_id", "canonical", "kind")


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT DISTINCT name, unnest(list_distinct(string_split(lower(name), ' '))) AS word FROM n)
SELECT name, other, shared FROM (SELECT a.name, b.name AS other, count(*) AS shared, row_number() OVER (PARTITION BY a.name ORDER BY count(*) DESC, b.name) AS r FROM w a JOIN w b USING (word) WHERE a.name != b.name AND word NOT IN ('small', 'large') GROUP BY 1, 2) WHERE r <= 5""")
def related_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five names that share most words with each name, sizes aside."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return taxonomy.related(names, "name", ("small", "large"))


@query("""
WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
b AS (SELECT trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS line, source FROM l WHERE length(line) BETWEEN 40 AND 200)
SELECT line, count(*) AS n, count(DISTINCT source) AS sources FROM b GROUP BY 1 HAVING count(DISTINCT source) >= 8""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 to 200 characters that eight sources at least carry."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    kept = lines.where("length(line) between 40 and 200").withColumn("line", X.squeezed(F.col("line")))
    return kept.groupBy("line").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")).where("sources >= 8")


@query(f"""
WITH w AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS context, count(*) AS turns FROM w GROUP BY 1""")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text, in the order of its turns. A conversation fits a row; the turns of none are unbounded."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")).alias("turn"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["line"]), "\n")
    return lines.groupBy("conv_id").agg(ordered.alias("context"), F.count("*").alias("turns"))


@query(f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, len(w) AS words, CASE WHEN len(w) <= 50 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:32], ' ') || ' ... ' || array_to_string(w[len(w) - 17:len(w)], ' ') END AS shortened FROM w""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 and last 18 words of documents of over 50; the shortening is the feature."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.words_in(text)).alias("words"), X.within_budget(text, 50).alias("shortened"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[@]|http') THEN 'address' WHEN contains(text, chr(10)) OR contains(text, chr(13)) THEN 'line_break' END AS reason FROM conversations WHERE regexp_matches(text, '[@]|http') OR contains(text, chr(10)) OR contains(text, chr(13))")
def noise_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that can't be a term because of an address or a line break."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", taxonomy.noise_reason(F.col("text")).alias("reason"))
    return turns.where(F.col("reason").isin("address", "line_break"))


@query("SELECT o_orderkey, sha256('[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\",\"' || o_custkey || '\"]') AS fingerprint FROM orders")
def job_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable hash over a JSON array of fields."""
    return table(spark, sf_dir, "orders").select("o_orderkey", X.json_hash(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")).alias("fingerprint"))

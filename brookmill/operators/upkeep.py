"""Upkeep of a dictionary (canonical, aliases, category, description) as snapshots, and what is proposed for it."""

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions.text import corporate_domain, email_domain, once, squeezed, taxonomy_key

from .listing import united
from .relational import latest

# Endings of a title that say where the work is, and what a line of boilerplate or of a requirement looks like.
TITLE_ENDINGS = r"(?i)\s*[-–—]\s*[A-Za-z .]{0,40}?\b(?:onsite|remote|hybrid)\b\.?\s*$|\s+in\s+[A-Z][a-zA-Z]+\s*$|\s*\((?:remote|onsite|hybrid)\)\s*$"
BOILERPLATE_HEADINGS = ("requirements", "required qualifications", "preferred qualifications", "responsibilities", "roles and responsibilities", "job responsibilities", "job description", "position summary", "about the role", "what you will do", "what you'll do", "what we are looking for", "skills and qualifications", "education and experience", "additional information", "equal opportunity employer")
BOILERPLATE_PATTERNS = (
    r"^to (?:apply|be considered),? please (?:send|submit|share).{0,140}(?:resume|cv)",
    r"^please (?:send|submit|share).{0,140}(?:resume|cv).{0,80}(?:rate|availability|contact)?$",
    r"^(?:click here|unsubscribe|manage (?:your )?preferences|view in browser)",
    r"^(?:this email|this message).{0,180}(?:confidential|intended recipient)",
    r"^(?:we are|our company is) an equal opportunity employer",
    r"^equal (?:employment )?opportunity.{0,180}$",
    r"^(?:strong|excellent) (?:written and verbal )?(?:communication|analytical|problem[- ]solving|organizational|time[- ]management|interpersonal|presentation)(?: and (?:communication|analytical|problem[- ]solving|organizational|time[- ]management|interpersonal|presentation))* (?:skills|abilities|capabilities)[.!]?$",
    r"^ability to manage multiple priorities in a fast[- ]paced environment[.!]?$",
    r"^perform other related duties as assigned[.!]?$",
)
REQUIREMENT_SIGNS = (r"\b\d+\+?\s*(?:years?|yrs?)\b", r"^(?:job title|location|rate|skills?|technology|certification)\s*:", r"\b(?:bachelor'?s|master'?s|phd|degree|certification|certified)\b", r"\b(?:experience with|experience in|hands[- ]on|proficiency in|knowledge of)\b", r"^(?:architect|build|configure|coordinate|create|develop|implement|lead|manage|provide|support|track|troubleshoot|work with)\b")
LONGEST_LINE = 220
# Words around skills that are wanted, welcome or ruled out, in the order in which they claim a skill.
CUES = {"required": r"\b(?:must[ -]?have|required|mandatory|need(?:ed)?|strong experience)\b", "preferred": r"\b(?:preferred|nice[ -]?to[ -]?have|good[ -]?to[ -]?have|bonus|plus)\b", "excluded": r"\b(?:exclude|excluded|without|must not have|no experience with)\b"}


def _keyed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("_key", taxonomy_key(F.col("canonical")))


def with_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries and new ones; one of a name that is there gives it its aliases, and fills an empty description."""
    both = _keyed(entries).withColumn("_new", F.lit(0)).unionByName(_keyed(new).withColumn("_new", F.lit(1))).where("_key != ''")
    first = lambda c: F.min_by(c, F.struct("_new", "canonical")).alias(c)
    described = F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.struct("_new", "description"))).alias("description")
    grouped = both.groupBy("_key").agg(first("canonical"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"), first("category"), described)
    return grouped.drop("_key").select(*entries.columns)


def without_entries(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Entries but those with one of the names (column canonical)."""
    return _keyed(entries).join(_keyed(names.select("canonical")).select("_key").distinct(), "_key", "left_anti").drop("_key").select(*entries.columns)


def renamed(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries after changes (canonical, new_name, category): the old name stays as an alias, a null keeps what was there."""
    wanted = _keyed(changes).groupBy("_key").agg(F.min_by(F.struct("new_name", F.col("category").alias("new_category")), F.struct("new_name", "category")).alias("_to"))
    out = _keyed(entries).join(wanted, "_key", "left")
    moved = F.col("_to.new_name").isNotNull() & (F.col("_to.new_name") != F.col("canonical"))
    return out.select(
        F.coalesce("_to.new_name", "canonical").alias("canonical"),
        F.when(moved, F.array_sort(F.array_remove(united(F.col("aliases"), F.array("canonical")), F.col("_to.new_name")))).otherwise(F.col("aliases")).alias("aliases"),
        F.coalesce("_to.new_category", "category").alias("category"),
        "description",
    ).select(*entries.columns)


def enriched(entries: DataFrame, found: DataFrame, generic: tuple[str, ...] = ("", "Uncategorized")) -> DataFrame:
    """Entries whose empty description, and category if it is a generic one, are filled from found (canonical, category, description)."""
    more = latest(_keyed(found).select("_key", F.col("category").alias("_c"), F.col("description").alias("_d")), ["_key"], ["_d", "_c"])
    out = _keyed(entries).join(more, "_key", "left")
    category = F.when(F.coalesce("category", F.lit("")).isin(*generic), F.coalesce("_c", "category")).otherwise(F.col("category"))
    return out.withColumns({"description": F.coalesce(F.nullif(F.col("description"), F.lit("")), "_d"), "category": category}).select(*entries.columns)


def flagged_proposals(proposals: DataFrame, index: DataFrame) -> DataFrame:
    """Proposals (canonical, kind alias or relation, value) with problem: alias_taken, own_name, unknown_target, self_relation, or null.

    index: key and canonical of every name and alias.
    """
    known = index.select(F.col("key").alias("_key"), F.col("canonical").alias("_owner"))
    out = proposals.join(known, taxonomy_key(F.col("value")) == F.col("_key"), "left")
    own = taxonomy_key(F.col("_owner")) == taxonomy_key(F.col("canonical"))
    problem = F.when((F.col("kind") == "alias") & F.col("_owner").isNotNull(), F.when(own, "own_name").otherwise("alias_taken")).when((F.col("kind") == "relation") & F.col("_owner").isNull(), "unknown_target").when((F.col("kind") == "relation") & own, "self_relation")
    return out.withColumn("problem", problem).drop("_key", "_owner")


def merged_requests(requests: DataFrame) -> DataFrame:
    """One row for each term and kind of suggestion: the fields that anybody asked for, distinct evidence, and the last time. Equal evidence counts once."""
    fields = F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields"))))
    return requests.groupBy("kind", taxonomy_key(F.col("term")).alias("key")).agg(F.min("term").alias("term"), fields.alias("fields"), F.countDistinct("evidence").alias("evidence"), F.max("at").alias("last_at"))


def bare_title(title: Column) -> Column:
    """A title without an ending that says where the work is; the title itself if nothing else is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(title, TITLE_ENDINGS, "")), F.lit("")), title)


def boilerplate_decision(line: Column) -> Column:
    """approve for lines that are surely boilerplate, reject for long or listed ones and requirements, else review."""
    clean = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))
    heading = F.regexp_replace(F.lower(clean), r"^[ :\-–—.!]+|[ :\-–—.!]+$", "")
    like = lambda patterns: functools.reduce(operator.or_, [clean.rlike(f"(?iu){p}") for p in patterns])
    sure, wanted = heading.isin(*BOILERPLATE_HEADINGS) | like(BOILERPLATE_PATTERNS), like(REQUIREMENT_SIGNS)
    return F.when(sure, "approve").when((F.length(clean) > LONGEST_LINE) | clean.rlike(r"^(?:[•●▪]|- )") | wanted, "reject").otherwise("review")


def cued_skills(clauses: DataFrame, terms: DataFrame, id_column: str, clause: str) -> DataFrame:
    """id, canonical and context: each skill of a text is claimed by the first context (required, preferred, excluded, mentioned) of a clause that holds it.

    terms: rows of id, clause number `at` and canonical; clauses: id, at and the clause's text.
    """
    context = F.coalesce(*[F.when(F.lower(clause).rlike(cue), F.lit(k)) for k, (_, cue) in enumerate(CUES.items())], F.lit(len(CUES)))
    ranked = terms.join(clauses.select(id_column, "at", context.alias("_rank")), [id_column, "at"]).groupBy(id_column, "canonical").agg(F.min("_rank").alias("_rank"))
    names = F.array(*[F.lit(c) for c in (*CUES, "mentioned")])
    return ranked.select(id_column, "canonical", F.get(names, F.col("_rank")).alias("context"))


def company_observation(company: Column, contact: Column, website: Column, sender: Column) -> Column:
    """Struct of domain, name, method, confidence and reason: which company a message is of.

    A signature's company with a corporate address wins; then with a website; then the sender's
    corporate domain. company: an already cleaned name or null.
    """
    address = lambda x: corporate_domain(email_domain(F.when(squeezed(x).rlike(r"^[^\s@]+@[^\s@]+$"), x)))
    host = corporate_domain(F.nullif(F.lower(F.regexp_extract(website, r"^https?://([^/?#:]+)", 1)), F.lit("")))
    found = F.struct(company.alias("company"), host.alias("host"), address(contact).alias("own"), address(sender).alias("sent"))
    return once(found, lambda x: _observed(x.company, x.host, x.own, x.sent))


def _observed(company: Column, host: Column, own: Column, sent: Column) -> Column:
    make = lambda domain, name, method, sure, reason: F.struct(domain.alias("domain"), name.alias("name"), F.lit(method).alias("method"), F.lit(sure).cast("double").alias("confidence"), F.lit(reason).cast("string").alias("reason"))
    none = F.lit(None).cast("string")
    signed = F.when(company.isNotNull() & own.isNotNull(), make(own, company, "signature", 0.9, "linked_signature")).when(company.isNotNull() & host.isNotNull(), make(host, company, "signature", 0.9, "linked_signature"))
    linked = F.when(sent.isNotNull(), make(sent, F.coalesce(company, sent), "sender_domain", 0.55, "linked_sender_domain"))
    missing = F.when(company.isNotNull(), make(none, none, "none", 0.0, "corporate_signature_email_missing")).otherwise(make(none, none, "none", 0.0, "company_name_missing_or_ambiguous"))
    return F.coalesce(signed, linked, missing)

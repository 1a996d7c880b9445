"""Resumes as arrays of sections: completeness, feedback on bullets, and words that a job asks for."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions.numbers import percent
from brookmill.functions.text import match_text

# Weights of a resume's quality, weak openings, and the least length of a bullet that is judged.
QUALITY_WEIGHTS = {"completeness": 0.45, "content": 0.30, "provenance": 0.25}
WEAK_OPENERS = ("responsible for", "helped with", "worked on", "involved in", "participated in", "assisted with", "in charge of", "duties included", "tasked with")
LEAST_BULLET = 25


def quality(sections: Column, required: Column) -> Column:
    """Struct of completeness, content, provenance and quality (percent), the missing sections and the decision.

    sections: array of (kind, content, verified). A share of nothing is 100 of the required sections
    and of the sections.
    """
    sections = F.coalesce(sections, F.array().cast("array<struct<kind:string,content:string,verified:boolean>>"))
    required = F.array_distinct(required)
    kinds = F.transform(sections, lambda s: s["kind"])
    missing = F.array_except(required, kinds)
    n = F.size(sections)
    full = F.size(F.filter(sections, lambda s: F.trim(F.coalesce(s["content"], F.lit(""))) != ""))
    sure = F.size(F.filter(sections, lambda s: F.coalesce(s["verified"], F.lit(False))))
    share = lambda part, whole: F.coalesce(percent(part, whole), F.lit(100.0))
    complete, content, proven = share(F.size(required) - F.size(missing), F.size(required)), share(full, n), share(sure, n)
    decision = F.when(n == 0, "blocked").when((F.size(missing) > 0) | (full < n) | (sure < n), "needs_review").otherwise("completed")
    total = complete * QUALITY_WEIGHTS["completeness"] + content * QUALITY_WEIGHTS["content"] + proven * QUALITY_WEIGHTS["provenance"]
    return F.struct(complete.alias("completeness"), content.alias("content"), proven.alias("provenance"), total.alias("quality"), missing.alias("missing"), decision.alias("decision"))


def bullets(content: Column) -> Column:
    """Lines of a section without list marks, those long enough to judge."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r?\n"), lambda s: F.regexp_replace(s, r"^[ \t\-•*]+|[ \t\-•*]+$", ""))
    return F.filter(lines, lambda s: F.length(s) >= LEAST_BULLET)


def feedback(sections: DataFrame, id_column: str, kind: str, content: str) -> DataFrame:
    """id, category, severity and current: bullets of experience without a number, and sections that open weakly."""
    unmeasured = sections.where(F.col(kind) == "experience").select(id_column, F.explode(F.filter(bullets(F.col(content)), lambda b: ~b.rlike("[0-9]"))).alias("current"))
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    weak = F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in WEAK_OPENERS])
    opening = sections.where(F.col(kind).isin("experience", "summary")).select(id_column, weak.alias("current")).where("current is not null")
    named = lambda df, category, severity: df.select(id_column, F.lit(category).alias("category"), F.lit(severity).alias("severity"), "current")
    return named(unmeasured, "unquantified_impact", "medium").unionByName(named(opening, "weak_language", "low"))


def missing_keywords(required: Column, skills: Column) -> Column:
    """Required skills, as they are spelled, that the resume's list lacks, whatever the case and marks."""
    held = F.transform(F.coalesce(skills, F.array().cast("array<string>")), match_text)
    return F.filter(F.array_distinct(required), lambda r: ~F.array_contains(held, match_text(r)))

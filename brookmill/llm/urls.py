"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over `host + path` with literal tokens that every url it fits
must hold. A count over the urls finds how rare each such token is, and the rule is filed under
its rarest one. A url's tokens fetch the rules filed under them, and only those run their
regular expressions. Rules without a literal token are tried on every url.

Two kinds of rule: prefix rules (a host with all its subdomains, and the start of a path) and
pattern rules (a regular expression and its literal tokens). Among the prefix rules that fit, the
longest decides, ties to the rule that sorts first; without one, any pattern rule that fits
blocks; otherwise the url is allowed.

Everything is DataFrame expressions. Up to `inline_rules` rules the index is a map inside the
plan; a larger list is joined on the token, salted, over the distinct urls.

Nulls and edges: a null url, or one without `://`, has an empty host and path, and no rule fits
it; repeated urls are judged alike; very long urls count in full; extra columns pass through
unless they carry the name of an output, which then replaces them.
"""

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_rows

INLINE_RULES, SALTS = 5_000, 16
OUTPUTS = ("host", "path", "rule", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    #: Length of a prefix rule; 0 for a pattern rule.
    length: int


def prefix_rule(verdict: str, rule: str) -> Rule:
    """A rule such as `example.org/en/1`: that host, its subdomains, and paths that start so."""
    host, slash, rest = rule.partition("/")
    whole = [t for t in re.split(r"[^a-z0-9]+", host.lower()) if t]
    whole += [t for t in re.split(r"[^a-z0-9]+", (slash + rest).lower())[:-1] if t]  # the last may go on
    quoted = "".join(re.sub(r"([^A-Za-z0-9/])", r"\\\1", c) for c in host.lower() + slash + rest)
    end = "" if slash else "(?:/|$)"
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{quoted}{end}", tuple(whole), len(rule))


def pattern_rule(name: str, regex: str, *tokens: str) -> Rule:
    """A rule that blocks what its regular expression finds; tokens: literals, each a whole token of such urls."""
    return Rule(name, "block", regex, tokens, 0)


#: Hosts and paths that carry advertisements or unsolicited goods in their names.
PATTERNS = (
    pattern_rule("spam host", r"^(?:[^/]*[.-])?spam(?:[.-][^/]*)?(?:/|$)", "spam"),
    pattern_rule("ads host", r"^(?:[^/]*[.-])?ads(?:[.-][^/]*)?(?:/|$)", "ads"),
    pattern_rule("pills host", r"^(?:[^/]*[.-])?pills(?:[.-][^/]*)?(?:/|$)", "pills"),
    pattern_rule("casino host", r"^(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)", "casino"),
    pattern_rule("free trial", r"(?i)(?:^|[^a-z0-9])free[_/-]trial(?:[^a-z0-9]|$)", "free", "trial"),
    pattern_rule("buy now", r"(?i)(?:^|[^a-z0-9])buy[_/-]now(?:[^a-z0-9]|$)", "buy", "now"),
    pattern_rule("click here", r"(?i)(?:^|[^a-z0-9])click[_/-]here(?:[^a-z0-9]|$)", "click", "here"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.split(F.translate(place, _UPPER, _LOWER), "[^a-z0-9]+"))


def _filed(urls: DataFrame, rules: list[Rule]) -> list[tuple[str | None, Rule]]:
    """Each rule with its rarest token, as counted over the column _tokens; None without tokens."""
    known = sorted({t for r in rules for t in r.tokens})
    wanted = F.array_intersect("_tokens", F.from_json(F.lit(json.dumps(known)), "array<string>"))
    counts = {r["t"]: r["n"] for r in urls.select(F.explode(wanted).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # one row for each token of the rules at most
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else None, r) for r in rules]


_RULE = "struct<name:string,verdict:string,regex:string,length:int>"


def _best(candidates: Column) -> Column:
    """Of the candidates that fit _place, the one that decides, or null."""
    fits = F.filter(candidates, lambda r: F.rlike(F.col("_place"), r["regex"]))
    ranked = F.array_sort(F.transform(fits, lambda r: F.struct((-r["length"]).alias("o"), r["name"].alias("name"), r["verdict"].alias("verdict"), r["length"].alias("length"))))
    return F.get(ranked, F.lit(0))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", inline_rules: int = INLINE_RULES) -> DataFrame:
    """pages with host, path, rule (the prefix rule that decides, else null) and verdict."""
    place = F.col(f"row.{url}")
    placed = whole_rows(pages).withColumn("host", host_of(place)).withColumn("path", path_of(place))
    placed = placed.withColumn("_place", F.concat("host", "path")).withColumn("_tokens", _tokens(F.col("_place")))
    filed = _filed(placed, rules)
    entry = lambda r: {"name": r.name, "verdict": r.verdict, "regex": r.regex, "length": r.length}
    always = F.from_json(F.lit(json.dumps([entry(r) for t, r in filed if t is None])), f"array<{_RULE}>")
    if len(rules) <= inline_rules:
        index: dict[str, list] = {}
        for token, r in filed:
            if token is not None:
                index.setdefault(token, []).append(entry(r))
        found = F.from_json(F.lit(json.dumps(index)), f"map<string,array<{_RULE}>>")
        fetched = F.flatten(F.filter(F.transform("_tokens", lambda t: F.try_element_at(found, t)), lambda x: x.isNotNull()))
        judged = placed.withColumn("_best", _best(F.concat(fetched, always)))
    else:
        spark = pages.sparkSession
        index_rows = spark.createDataFrame([(t, r.name, r.verdict, r.regex, r.length) for t, r in filed if t is not None], "token string, name string, verdict string, regex string, length int")
        index_rows = index_rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        places = placed.select("_place", "_tokens").dropDuplicates(["_place"])
        tokens = places.select("_place", F.explode("_tokens").alias("token"), F.pmod(F.xxhash64("_place"), F.lit(SALTS)).cast("int").alias("salt"))
        fits = tokens.join(index_rows, ["token", "salt"]).where(F.expr("_place rlike regex"))
        ranked = F.struct((-F.col("length")).alias("o"), "name", "verdict", "length")
        best = fits.groupBy("_place").agg(F.min(ranked).alias("_by_token"))
        judged = placed.join(best, "_place", "left").withColumn("_by_rule", _best(always))
        judged = judged.withColumn("_best", F.least("_by_token", "_by_rule")).drop("_by_token", "_by_rule")
    by_prefix = F.col("_best.length") > 0
    judged = judged.withColumn("rule", F.when(by_prefix, F.col("_best.name"))).withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit("allow")))
    given = [F.col(f"row.`{c}`") for c in pages.columns if c.lower() not in OUTPUTS]
    return judged.select(*given, *OUTPUTS)

"""The best jobs of every resume, without comparing all with all.

A set of required skills is met by the resumes that can cover the given share of it. Of n skills,
`held` must be covered, so such a resume has one of the n - held + 1 rarest of them: only these are
looked up, in rows that are dealt over a grid of cells, so that a skill of everyone's meets no large
group. Jobs aren't met one by one: for each set and each of the resumes' terms (years, authorisation,
place) that meet it, the jobs' own terms are ranked once, among all and among those that want the
same skills, and only the k best go on. Sets whose best job can't be among the k best of a resume go.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions.text import match_text, once, taxonomy_key
from brookmill.llm.common import saved

from .matching import REVIEW_SKILL, WEIGHTS, authorization_key, authorization_score, decision, location_score, match_score, overlap_percent, years_score

#: Rows of one skill on either side of a cell.
CELL = 2_000
#: Forms of jobs in one row, and lists of jobs in one row.
PART = 500
#: Points by which rounding to 2 decimals can change an order, and some more.
ROUNDED = 0.02
_OFFER = ("years_experience", "work_authorization", "location")


def skill_keys(df: DataFrame, id_column: str, skills: list[str], index: DataFrame) -> DataFrame:
    """df with each array of skills as an array of the structs key and name, one for each key, as first spelled.

    index: key, canonical (`taxonomy.alias_index`). Skills that it knows by any name have the canonical
    name as key, all others their own text; blank ones go. df's ids are distinct.
    """
    arrays = F.array(*[F.struct(F.lit(i).alias("side"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("names")) for i, c in enumerate(skills)])
    rows = df.select(F.col(id_column).alias("_id"), F.explode(arrays).alias("a")).select("_id", "a.side", F.posexplode("a.names").alias("at", "name"))
    rows = rows.withColumn("name", F.trim("name")).where(match_text(F.col("name")) != "")
    known = index.select(F.col("key").alias("_key"), match_text(F.col("canonical")).alias("_canonical"))
    rows = rows.join(known, taxonomy_key(F.col("name")) == F.col("_key"), "left")
    one = rows.groupBy("_id", "side", F.coalesce(F.nullif("_canonical", F.lit("")), match_text(F.col("name"))).alias("key")).agg(F.min_by("name", "at").alias("name"))
    held = lambda i: F.array_sort(F.collect_list(F.when(F.col("side") == i, F.struct("key", "name"))))
    found = one.groupBy("_id").agg(*[held(i).alias(f"_side{i}") for i in range(len(skills))])
    out = df.join(found, F.col(id_column) == F.col("_id"), "left").drop("_id")
    none = F.array().cast("array<struct<key:string,name:string>>")
    return out.withColumns({c: F.coalesce(f"_side{i}", none) for i, c in enumerate(skills)}).drop(*[f"_side{i}" for i in range(len(skills))])


def _keys(x: str) -> Column:
    return F.transform(x, lambda s: s["key"])


def _id(*parts: str) -> Column:
    """The same bytes for rows that are alike in all parts, nulls included."""
    return F.unhex(F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})))


def _met(left: DataFrame, right: DataFrame, key: str, ids: tuple[str, str], tasks: int, cell: int) -> DataFrame:
    """The join by one key; the rows of a key on either side are dealt over a grid of cells by the hash of their ids."""
    of = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count("*") / cell).cast("int").alias(name))
    cells, place = of(left, "_row").join(of(right, "_column"), key), [key, "_row", "_column"]

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        out = rows.join(cells, key).withColumn(own, F.pmod(F.xxhash64(by), F.col(own)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).repartition(tasks, *place)  # few rows make many, so tasks aren't merged

    return dealt(left, ids[0], "_row", "_column").join(dealt(right, ids[1], "_column", "_row"), place).drop("_row", "_column")


def _cut(found: Column, k: int) -> Column:
    """Of structs of o (the rest of the score, negative), y, w, l, id and more those that may be among the k best by rounded score and id, in order."""

    def of(s: Column) -> Column:
        last = F.get(s, F.least(F.lit(k), F.size(s)) - 1)["o"]
        alike = lambda a, b: (a["y"] == b["y"]) & (a["w"] == b["w"]) & (a["l"] == b["l"])
        return F.filter(s, lambda e, i: (e["o"] <= last + ROUNDED) & ~F.coalesce(alike(F.get(s, i - k), e), F.lit(False)))

    return once(F.array_sort(found), of)


def _best_forms(forms: Column, terms: str, k: int) -> Column:
    """Structs of o, y, w, l and id of the k best jobs and those close behind, of forms (job, ids: in order) by a resume's terms."""
    mine = lambda f: F.col(f"{terms}.{f}")

    def scores(form: Column) -> Column:
        job = form["job"]
        y, w, l = (years_score(mine("years_experience"), job["years_experience"]), authorization_score(mine("work_authorization"), job["work_authorization"], True), location_score(mine("location"), job["location"], True))  # noqa: E741
        return once(F.struct(y.alias("y"), w.alias("w"), l.alias("l")), lambda v: F.struct((-match_score(F.lit(0.0), F.lit(0.0), v["y"], v["w"], v["l"])).alias("o"), v["y"].alias("y"), v["w"].alias("w"), v["l"].alias("l"), F.get(form["ids"], F.lit(0)).alias("id"), form["ids"].alias("ids")))

    each = F.transform(_cut(F.transform(forms, scores), k), lambda f: F.transform(f["ids"], lambda i: F.struct(*[f[x].alias(x) for x in ("o", "y", "w", "l")], i.alias("id"))))
    return _cut(F.flatten(each), k)


def best_jobs(resumes: DataFrame, jobs: DataFrame, index: DataFrame, k: int = 10, least: float = REVIEW_SKILL, cell: int = CELL) -> DataFrame:
    """The k best jobs of each resume among those of whose required skills it has `least` percent: by score, then smaller job_id.

    resumes: resume_id, skills, years_experience, work_authorization, location; jobs: job_id,
    required_skills (if there are none, skills stand in, where the column exists), preferred_skills and
    the same three. Ids are distinct. index: `taxonomy.alias_index`. Any pair below `least` is rejected
    at the usual 60 percent. Jobs that require no skill fit everyone alike and take no part. Result:
    resume_id, rank (from 1), job_id, match_score (2 decimals), decision and matched_required,
    missing_required and matched_preferred as the job spells them.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be over 0 and at most 100 percent")
    wanted = F.col("required_skills")
    if "skills" in jobs.columns:
        wanted = F.when(F.size(F.coalesce(wanted, F.array().cast("array<string>"))) > 0, wanted).otherwise(F.col("skills"))
    parts = [F.col("years_experience"), authorization_key(F.col("work_authorization")).alias("work_authorization"), F.coalesce(match_text(F.col("location")), F.lit("")).alias("location")]
    offers = skill_keys(resumes.select("resume_id", "skills", *parts), "resume_id", ["skills"], index).withColumn("skills", _keys("skills")).where(F.size("skills") > 0)
    asks = skill_keys(jobs.select("job_id", wanted.alias("required"), F.col("preferred_skills").alias("preferred"), *parts), "job_id", ["required", "preferred"], index).where(F.size("required") > 0)
    tasks = int(resumes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = saved(offers.withColumns({"offer": _id("skills", *_OFFER), "terms": _id(*_OFFER)}))
    offer = told.groupBy("offer").agg(F.first("terms").alias("terms"), F.first("skills").alias("skills"))
    terms = told.groupBy("terms").agg(*[F.first(c).alias(c) for c in _OFFER]).select("terms", F.struct(*_OFFER).alias("resume"))
    asks = saved(asks)
    asked = asks.select("job_id", _keys("required").alias("required_keys"), _keys("preferred").alias("preferred_keys"), *_OFFER)
    asked = asked.withColumns({"set": _id("required_keys"), "want": _id("preferred_keys"), "form": _id(*_OFFER)})

    # which resumes cover which sets of required skills
    sets = asked.groupBy("set").agg(F.first("required_keys").alias("required_keys"))
    counts = offer.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    required = sets.select("set", F.explode("required_keys").alias("skill")).join(counts, "skill", "left")
    size = F.size("rare")
    held = lambda n: F.ceil(n * F.lit(least) / 100 - 1e-9).cast("int")
    prefix = required.groupBy("set").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "skill"))).alias("rare"))
    prefix = prefix.select("set", F.slice(F.transform("rare", lambda s: s["skill"]), F.lit(1), size - held(size) + 1).alias("prefix"))
    left = offer.withColumn("skill", F.explode("skills"))
    right = prefix.join(sets, "set").withColumn("skill", F.explode("prefix"))
    met = _met(left, right, "skill", ("offer", "set"), tasks, cell).where(F.get(F.array_intersect("prefix", "skills"), F.lit(0)) == F.col("skill"))
    met = met.where(F.size(F.array_intersect("required_keys", "skills")) >= held(F.size("required_keys")))
    pairs = saved(met.select("offer", "terms", "set", overlap_percent(F.col("required_keys"), F.col("skills"), 100.0).alias("a")))

    # jobs alike in all as one form with its k smallest ids; forms that want the same skills in bounded rows
    first = Window.partitionBy("set", "want", "form").orderBy("job_id")
    forms = asked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).groupBy("set", "want", "form")
    forms = forms.agg(F.first("preferred_keys").alias("preferred"), F.first(F.struct(*_OFFER)).alias("job"), F.array_sort(F.collect_list("job_id")).alias("ids"))
    wants = forms.groupBy("set", "want").agg(F.count("*").alias("forms"))
    parts = wants.groupBy("set").agg(F.ceil(F.count("*") / PART).alias("parts"))
    sized = wants.join(parts, "set").select("set", "want", F.ceil(F.col("forms") / PART).alias("chunks"), F.pmod(F.xxhash64("want"), "parts").alias("part"))
    chunks = forms.join(sized, ["set", "want"]).groupBy("set", "want", F.pmod(F.xxhash64("form"), "chunks").alias("chunk"))
    chunks = chunks.agg(F.first("part").alias("part"), F.first("preferred").alias("preferred"), F.collect_list(F.struct("job", "ids")).alias("forms"))

    # for each set and the terms of a resume that covers it: the best jobs of each wanted skills, and those of all
    needed = pairs.select("set", "terms").distinct().join(terms, "terms")
    listed = _met(needed, chunks, "set", ("terms", "want"), tasks, cell).select("set", "terms", "part", "preferred", _best_forms(F.col("forms"), "resume", k).alias("best"))
    lists = saved(listed.groupBy("set", "terms", "part").agg(F.collect_list(F.struct("preferred", "best")).alias("lists")))
    flat = lambda x: F.flatten(F.transform(x, lambda p: F.transform(p["best"], lambda e: F.struct(*[e[f].alias(f) for f in ("o", "y", "w", "l", "id")], p["preferred"].alias("preferred")))))
    lead = lists.select("set", "terms", _cut(flat(F.col("lists")), k).alias("lead")).groupBy("set", "terms").agg(_cut(F.flatten(F.collect_list("lead")), k).alias("lead"))

    # a set whose best job stays behind the k-th of another set goes
    reach = lead.select("set", "terms", (-F.get("lead", F.lit(0))["o"]).alias("most"), (-F.get("lead", F.lit(k - 1))["o"]).alias("sure"))
    own = F.col("a") * WEIGHTS["required_skill"]
    surest = F.max(own + F.col("sure")).over(Window.partitionBy("offer"))
    kept = pairs.join(reach, ["set", "terms"]).withColumn("_least", surest)
    kept = kept.where(F.col("_least").isNull() | (own + F.col("most") + 100 * WEIGHTS["preferred_skill"] + ROUNDED >= F.col("_least"))).select("offer", "terms", "set", "a")

    # jobs whose wanted skills a resume has are ranked among their own, others among all
    alone = F.transform("lead", lambda e: F.struct(e["preferred"].alias("preferred"), F.array(F.struct(*[e[f].alias(f) for f in ("o", "y", "w", "l", "id")])).alias("best")))
    both = lists.select("set", "terms", "lists", F.lit(True).alias("held")).unionByName(lead.select("set", "terms", alone.alias("lists"), F.lit(False).alias("held")))

    def scored(p: Column) -> Column:
        b = overlap_percent(p["preferred"], F.col("skills"), 0.0)
        score = lambda e, b: F.bround(match_score(F.col("a"), b, e["y"], e["w"], e["l"]), 2)
        return once(b, lambda b: F.transform(p["best"], lambda e: F.struct((-score(e, b)).alias("o"), e["id"].alias("id"), F.col("a").alias("a"), e["y"].alias("y"), e["w"].alias("w"))))

    top = lambda x: F.slice(F.array_sort(F.flatten(x)), 1, k)
    fits = F.filter("lists", lambda p: F.arrays_overlap(p["preferred"], F.col("skills")) == F.col("held"))
    some = kept.join(offer.select("offer", "skills"), "offer").join(both, ["set", "terms"]).select("offer", top(F.transform(fits, scored)).alias("best")).where(F.size("best") > 0)
    each = some.groupBy("offer").agg(top(F.collect_list("best")).alias("best")).select("offer", F.posexplode("best").alias("rank", "e"))
    each = each.select("offer", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("job_id"), (-F.col("e.o")).alias("match_score"), F.col("e.a").alias("a"), F.col("e.y").alias("y"), F.col("e.w").alias("w"))
    each = each.withColumn("decision", decision(F.col("match_score"), F.col("a"), F.col("y"), F.col("w"))).drop("a", "y", "w")
    out = each.join(told.select("offer", "resume_id"), "offer").drop("offer")
    out = out.join(asks.select("job_id", "required", "preferred"), "job_id").join(told.select("resume_id", "skills"), "resume_id")
    has = lambda x, yes: F.transform(F.filter(x, lambda s: F.array_contains("skills", s["key"]) == yes), lambda s: s["name"])
    return out.select("resume_id", "rank", "job_id", "match_score", "decision", has("required", True).alias("matched_required"), has("required", False).alias("missing_required"), has("preferred", True).alias("matched_preferred"))

"""Multi-record parsers of message bodies: tables, blocks, sections, key-value lists, signatures.

Each cuts a text into lines or sections with Column expressions and explodes these to rows, so a
parse stays in the plan; only ordered look-back over lines uses a window per message.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions.text import header_key, name_parts, split_list

from . import extract

# Names of table columns and of resume sections.
HEADERS = {
    "name": "name", "candidate": "name", "candidate name": "name", "consultant": "name", "consultant name": "name", "resource": "name", "resource name": "name",
    "title": "title", "job title": "title", "role": "title", "technology": "title", "skill": "title", "skills": "title", "primary skill": "title", "primary skills": "title",
    "experience": "experience", "exp": "experience", "years": "experience", "total experience": "experience",
    "location": "location", "current location": "location",
    "visa": "visa", "visa status": "visa", "work authorization": "visa", "work auth": "visa",
    "availability": "availability", "available": "availability", "available from": "availability",
    "rate": "rate", "bill rate": "rate", "expected rate": "rate",
    "email": "email", "candidate email": "email", "phone": "phone", "mobile": "phone",
}
FIELDS = ("name", "title", "experience", "location", "visa", "rate", "availability", "email", "phone")
SECTIONS = {"summary": "summary|profile|objective", "experience": "experience|work experience|employment history|professional experience", "education": "education|academics?", "skills": "skills|technical skills|technologies", "certifications": "certifications?|licenses?"}
SIGN_OFFS = "regards|best regards|kind regards|warm regards|thanks|thank you|thanks and regards|thanks & regards|sincerely|best"
QUOTES = r"(?im)^(?:-+ ?original message ?-+|from:[ \t]|on .{5,80} wrote:|>)"


def lines_of(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, at (line number from 0) and line, trimmed."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda s: F.trim(s))
    return df.select(id_column, F.posexplode(lines).alias("at", "line"))


def hotlist_table(df: DataFrame, id_column: str, text: str, by: str = r"\|") -> DataFrame:
    """Records of a table in the text: the first line with two known headers names the columns; later lines with as many cells are records.

    Confidence is 0.92 with a name and a title, 0.62 with either, else 0.30 and a warning.
    """
    cells = F.transform(F.split(F.regexp_replace("line", rf"^\s*{by}|{by}\s*$", ""), by), lambda s: F.trim(s))
    rows = lines_of(df, id_column, text).where(F.col("line").rlike(by)).withColumn("cells", cells)
    keys = F.transform("cells", lambda c: header_key(c, HEADERS))
    known = F.array(*[F.lit(f) for f in FIELDS])
    rows = rows.withColumn("keys", keys).withColumn("is_header", F.size(F.array_intersect("keys", known)) >= 2)
    header = rows.where("is_header").groupBy(id_column).agg(F.min_by(F.struct("at", "keys"), "at").alias("header"))
    body = rows.join(header, id_column).where((F.col("at") > F.col("header.at")) & (F.size("cells") == F.size("header.keys")) & ~F.col("is_header"))
    value = lambda f: F.nullif(F.try_element_at("cells", F.array_position("header.keys", f).cast("int")), F.lit(""))
    at = lambda f: F.when(F.array_contains("header.keys", f), value(f))
    out = body.select(id_column, "at", *[at(f).alias(f) for f in FIELDS])
    sure = F.when(F.col("name").isNotNull() & F.col("title").isNotNull(), 0.92).when(F.col("name").isNotNull() | F.col("title").isNotNull(), 0.62).otherwise(0.30)
    return out.withColumn("parse_confidence", sure).withColumn("warnings", F.array_compact(F.array(F.when(F.col("name").isNull(), F.lit("name_missing")), F.when(F.col("title").isNull(), F.lit("title_missing")))))


def positions(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row for each position of a requirement: sections that start with `Job Title:`, or the whole text without one.

    Columns: id, position (from 1), title, section, location, employment_type, work_authorization,
    years, skills, confidence.
    """
    marked = F.split(F.coalesce(F.col(text), F.lit("")), r"(?im)(?=^[ \t]*(?:job[ \t]+title|position|role)[ \t]*[:-])")
    several = F.filter(marked, lambda s: s.rlike(r"(?i)^[ \t]*(?:job[ \t]+title|position|role)[ \t]*[:-]"))
    sections = F.when(F.size(several) > 0, several).otherwise(F.array(F.coalesce(F.col(text), F.lit(""))))
    out = df.select(id_column, F.posexplode(sections).alias("position", "section")).withColumn("position", F.col("position") + 1)
    section = F.col("section")
    skills = split_list(F.regexp_extract(section, r"(?im)^[ \t]*(?:required|mandatory)?[ \t]*skills?[ \t]*[:-][ \t]*(.*)$", 1))
    title = F.nullif(F.regexp_extract(section, r"(?im)^[ \t]*(?:job[ \t]+title|position|role)[ \t]*[:-][ \t]*(\S.*?)[ \t]*$", 1), F.lit(""))
    out = out.select(id_column, "position", title.alias("title"), "section", extract.location(section).alias("location"), extract.employment_type(section).alias("employment_type"), extract.work_authorization(section).alias("work_authorization"), extract.years_of_experience(section).alias("years"), skills.alias("skills"))
    evidence = (F.size("skills") > 0) | F.col("years").isNotNull()
    return out.withColumn("confidence", extract.requirement_confidence(F.col("title").isNotNull(), evidence, F.col("location").isNotNull()))


def sections(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, section and its lines: every line under the last header above it (`header` before the first)."""
    name = F.coalesce(*[F.when(F.lower(F.regexp_replace("line", r"[\s:]+$", "")).rlike(f"^(?:{p})$"), F.lit(k)) for k, p in SECTIONS.items()])
    rows = lines_of(df, id_column, text).withColumn("starts", name)
    above = Window.partitionBy(id_column).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last("starts", ignorenulls=True).over(above), F.lit("header")))
    kept = rows.where("starts is null and line != ''").groupBy(id_column, "section").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    return kept.select(id_column, "section", F.transform("rows", lambda r: r["line"]).alias("lines"))


def key_values(x: Column) -> Column:
    """Map of the `Key: value` lines of a text, keys as header keys; the last of equal keys stays."""
    lines = F.filter(F.split(F.coalesce(x, F.lit("")), r"\r?\n"), lambda s: s.rlike(r"^[ \t]*[A-Za-z][A-Za-z0-9 /_-]{0,40}:[ \t]*\S"))
    pairs = F.transform(lines, lambda s: F.struct(header_key(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"]))


def signature(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Contact details under the last sign-off before any quoted message.

    Confidence is 0.92 with a name and two of title, company, phone and email, 0.70 with a name and
    one, 0.45 with anything, else 0.
    """
    own = F.get(F.split(F.coalesce(F.col(text), F.lit("")), QUOTES), F.lit(0))
    block = F.regexp_extract(own, rf"(?is)^.*(?:^|\n)[ \t]*(?:{SIGN_OFFS})[ \t]*[,.!]?[ \t]*\n(.*)$", 1)
    lines = F.filter(F.transform(F.split(block, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    named = F.filter(lines, lambda s: s.rlike(r"^[A-Z][A-Za-z.'-]*(?: [A-Z][A-Za-z.'-]*){1,3}$"))
    plain = F.filter(lines, lambda s: ~s.rlike(r"[@\d]|www|http"))
    name = F.get(named, F.lit(0))
    rest = F.filter(plain, lambda s: ~s.eqNullSafe(name))
    out = df.select(id_column, block.alias("block"), name.alias("name"), F.get(F.filter(rest, lambda s: F.lower(s).rlike("manager|recruiter|director|lead|engineer|president|consultant|executive|specialist")), F.lit(0)).alias("title"), F.get(F.filter(rest, lambda s: F.lower(s).rlike(r"\b(?:inc|llc|ltd|corp|technologies|solutions|group|consulting|systems)\b")), F.lit(0)).alias("company"), extract.phone(block).alias("phone"), extract.email(block).alias("email"), extract.linkedin(block).alias("linkedin"))
    found = sum((F.col(c).isNotNull().cast("int") for c in ("title", "company", "phone", "email")), F.lit(0))
    sure = F.when(F.col("name").isNotNull() & (found >= 2), 0.92).when(F.col("name").isNotNull() & (found == 1), 0.70).when(F.col("name").isNotNull() | (found > 0), 0.45).otherwise(0.0)
    return out.withColumn("parts", name_parts(F.col("name"))).withColumn("confidence", sure).drop("block")


def without_boilerplate(df: DataFrame, id_column: str, text: str, approved: DataFrame) -> DataFrame:
    """df with its text less lines that are approved as boilerplate (column line, squeezed); never empty: then the text stays.

    Lines meet the approved ones by a join on the squeezed line.
    """
    from brookmill.functions.text import squeezed

    rows = lines_of(df, id_column, text).withColumn("line_key", squeezed(F.col("line")))
    kept = rows.join(approved.select(F.col("line").alias("line_key")).distinct(), "line_key", "left_anti")
    joined = kept.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("_rows")).select(id_column, F.array_join(F.transform("_rows", lambda r: r["line"]), "\n").alias("_clean"))
    return df.join(joined, id_column, "left").withColumn(text, F.coalesce(F.nullif(F.trim("_clean"), F.lit("")), F.col(text))).drop("_clean")

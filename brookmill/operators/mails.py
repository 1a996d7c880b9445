"""Business records of mails: the consultants of a hotlist, the positions of a requirement.

A mail is read within its row, as arrays of lines, cells and sections, so nothing is shuffled. All
patterns stay on a line, and none is tried again from within what it has read.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookmill.functions.text import header_key, labelled_value, once, split_list

from . import extract
from .parsers import HEADERS
from .signatures import SIGN_OFF

# Names of columns that hold skills, labels of a consultant's lines, skills known by name, codes of states.
COLUMNS = HEADERS | {"skill": "skills", "skills": "skills", "primary skill": "skills", "primary skills": "skills"}
NAMED = ("name", "candidate", "consultant")
SKILLS = ("Java", "Spring Boot", "AWS", "REST API", "Python", "React", "Node.js", "PostgreSQL", "Docker", "Kubernetes", "TypeScript", "Angular", "Azure", "GCP", "SQL", "MongoDB")
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
# Lines above a requirement that aren't part of it, texts that end one, labels and words of titles.
PREAMBLE = (
    r"(?i)^\s*(?:(?:from|sent|to|subject|cc|bcc)\s*:|you received this email from\b|please check the email id\b|\[?external\]?\s*$|external\s+email\b"
    r"|caution\s*[:\-].*(?:external|outside)|this\s+(?:email|message)\s+originated\s+(?:from\s+)?outside\b|you\s+don.t\s+often\s+get\s+email\s+from\b"
    r"|report\s+this\s+email\b|remove\s*/\s*unsubscribe\b)"
)
FOOTERS = ("view this job online", "unsubscribe", "keywords:")
POSITION = r"[ \t]*(?:job title|title|position|role)[ \t]*[:\-]"
NUMBERED = r"[ \t]*[0-9]{1,2}[ \t]*\)"
DUTIES = r"(?i)\b(?:role\s*descriptions?|(?:key\s*)?responsibilit(?:y|ies)|(?:job\s*)?duties)\b"
ASKING = r"(?i)^(?:(?:urgent|immediate) )?(?:need|hiring|looking for|seeking)(?: ?: ?| )(?:for )?"
TITLED = r"(?i)^((?:[A-Za-z]|\.NET\b)[A-Za-z0-9 .+#/()&-]{2,80}?)(?: with| having| for| -| ?\|| ?_|,|$)"
TITLE_WORDS = "developer|engineer|architect|analyst|administrator|admin|manager|consultant|recruiter|lead|designer|researcher|technician|scientist|specialist|tester"
HEADED = r"(?m)^[ \t]*(\S[^\n]{0,98}?(?i:developer|engineer|architect|analyst|designer|researcher|technician|scientist|specialist|tester|manager|administrator|consultant|lead)(?: L[123])?)[ \t]*\n\s*(?:(?i:location)[ \t]*[:\-]|[A-Z][A-Za-z .]+,[ \t]*[A-Z]{2}\b)"
COMPANY = r"(?im)^[ \t]*(?:end[ \t\-]?client|client[ \t]*name|client|company[ \t]*name|company|employer)[ \t]*[:\-][ \t]*([A-Za-z0-9][A-Za-z0-9 &.,'\-]{1,80}?)[ \t]*$"
WANTED = ("Required Skills", "Must Have Skills", "Mandatory Skills", "Skills Required")
#: The longest title, the shortest text whose skills are evidence, and the confidence below which someone looks.
LONGEST_TITLE, LEAST_TEXT, REVIEW = 100, 40, 0.70

CONSULTANT = "name string, email string, phone string, title string, skills array<string>, years int, location string, work_authorization string, availability string, rate string, source int, parse_confidence double, requires_review boolean, warnings array<string>"
JOB = "job_title string, job_description string, company string, skills array<string>, years int, location string, work_authorization string, employment_type string, rate string, source int, parse_confidence double, requires_review boolean, warnings array<string>"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|(?<!\s)\s+$", "")


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def _body(text: Column) -> Column:
    """The text with plain line ends, without a subject as its first line."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return _stripped(F.regexp_replace(plain, r"(?i)\A[^\S\n]*subject:[^\n]*", ""))


def _skills(text: Column) -> Column:
    """The skills known by name that the text holds."""
    return once(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(low.contains(s.lower()), F.lit(s)) for s in SKILLS])))


def _pieces(text: Column, start: str) -> Column:
    """The text cut before every line that starts with the pattern."""
    return F.filter(F.split(text, f"(?im)(?=^{start})"), lambda p: p != "")


def _joined(pieces: Column, starts: Column) -> Column:
    """Pieces from each start (places from 0) up to the next one, as one section each; what lies before the first goes."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(pieces)))
    return F.zip_with(starts, ends, lambda a, b: _stripped(F.array_join(F.slice(pieces, a + 1, b - a), "")))


def _summary(records: Column, if_none: list[str], if_weak: str) -> Column:
    """Struct of records, their number, the least confidence, requires_review and warnings."""

    def of(records: Column) -> Column:
        none, weak = F.size(records) == 0, F.exists(records, lambda r: r["requires_review"])
        least = F.coalesce(F.array_min(F.transform(records, lambda r: r["parse_confidence"])), F.lit(0.0))
        warnings = F.array_compact(F.array(*[F.when(none, F.lit(w)) for w in if_none], F.when(weak, F.lit(if_weak))))
        return F.struct(records.alias("records"), F.size(records).alias("record_count"), least.alias("confidence"), (none | weak).alias("requires_review"), warnings.alias("warnings"))

    return once(records, of)


def _consultant(values: Column) -> Column:
    """A consultant's record of a struct of name, ..., source: sure with a name and a title or skills."""
    named, able = values["name"].isNotNull(), values["title"].isNotNull() | (F.size(values["skills"]) > 0)
    sure = F.when(named & able, 0.92).when(named | able, 0.62).otherwise(0.30)
    warnings = F.array_compact(F.array(F.when(~named, F.lit("candidate_name_missing")), F.when(~able, F.lit("candidate_title_or_skills_missing"))))
    fields = [values[f].alias(f) for f in ("name", "email", "phone", "title", "skills", "years", "location", "work_authorization", "availability", "rate", "source")]
    return F.struct(*fields, sure.alias("parse_confidence"), (sure < REVIEW).alias("requires_review"), warnings.alias("warnings")).cast(f"struct<{as_fields(CONSULTANT)}>")


def as_fields(fields: str) -> str:
    """Columns of a schema as the fields of a struct type."""
    return re.sub(r"(\w+) (array<string>|\w+)", r"\1:\2", fields)


def _table(body: Column, by: str) -> Column:
    """Consultants of the first table of cells between `by`: its header has two known names, every later line with cells is one.

    Of columns of one name the last that the line reaches counts. source: the line among those that aren't blank.
    """
    known = F.create_map(*[F.lit(v) for kv in COLUMNS.items() for v in kv])
    lines = F.filter(F.split(body, "\n"), lambda s: _stripped(s) != "")  # a line may start with an empty cell
    rows = F.transform(lines, lambda s, i: F.struct((i + 1).alias("at"), F.split(s, re.escape(by)).alias("cells")))
    keyed = F.transform(F.filter(rows, lambda r: F.size(r["cells"]) > 1), lambda r: F.struct(r["at"].alias("at"), r["cells"].alias("cells"), F.transform(r["cells"], lambda c: F.try_element_at(known, header_key(c))).alias("keys")))

    def record(row: Column, keys: Column) -> Column:
        def value(name: str) -> Column:
            held = F.array_compact(F.zip_with(keys, row["cells"], lambda k, c: F.when(k == name, _stripped(c))))
            return F.nullif(F.try_element_at(held, F.lit(-1)), F.lit(""))

        years = F.regexp_extract(value("experience"), r"\b([0-9]{1,2})\b", 1).try_cast("int")
        fields = {"skills": split_list(value("skills")), "years": F.when(years <= 60, years), "work_authorization": value("visa"), "source": row["at"]}
        plain = {f: value(f) for f in ("name", "email", "phone", "title", "location", "availability", "rate")}
        return once(F.struct(*[c.alias(f) for f, c in (plain | fields).items()]), _consultant)

    def of(keyed: Column) -> Column:
        header = F.get(F.filter(keyed, lambda r: F.size(F.array_compact(r["keys"])) >= 2), F.lit(0))
        return once(header, lambda h: F.transform(F.filter(keyed, lambda r: r["at"] > h["at"]), lambda r: record(r, h["keys"])))

    return F.when(body.contains(by), once(keyed, of))


def _blocks(body: Column) -> Column:
    """Consultants of blocks between blank lines that have a name's label, else of the whole text.

    Where a block repeats the label of its first name, each repetition starts another consultant.
    """
    label = rf"[ \t]*(?:{'|'.join(NAMED)})[ \t]*[:\-]"
    blocks = F.filter(F.split(body, r"\n[^\S\n]*\n\s*"), lambda b: b.rlike(f"(?im)^{label}"))

    def parts(block: Column) -> Column:
        opener = F.lower(F.regexp_extract(block, rf"(?im)^[ \t]*({'|'.join(NAMED)})[ \t]*[:\-]", 1))

        def cut(word: str) -> Column:
            own = rf"[ \t]*{word}[ \t]*[:\-]"
            headed = lambda p: F.when(F.get(p, F.lit(0)).rlike(f"(?i)^{own}"), p).otherwise(F.concat(F.array(F.array_join(F.slice(p, 1, 2), "")), F.slice(p, F.lit(3), F.size(p))))
            return F.when(opener == word, once(_pieces(block, own), headed))

        return F.coalesce(*[cut(word) for word in NAMED])

    cut = F.flatten(F.transform(blocks, parts))
    texts = F.when(F.size(cut) > 0, cut).when(body != "", F.array(body)).otherwise(F.array().cast("array<string>"))
    return F.transform(texts, lambda b, i: once(_labelled(b, i), _consultant))


def _labelled(block: Column, place: Column) -> Column:
    low = F.lower(block)
    words = lambda pattern: low.rlike(f"(^|[^a-z0-9_])(?:{pattern})([^a-z0-9_]|$)")
    name = F.coalesce(labelled_value(block, "name", "candidate", "candidate name", "consultant"), _found(block, r"Name[:\-]?\s*([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)"))
    title = F.coalesce(labelled_value(block, "title", "job title", "role", "technology"), F.trim(_found(block, r"(?i)(?<![A-Za-z0-9_ \t])([A-Za-z0-9_ \t]+(?:developer|engineer|architect|analyst|consultant))")))
    visa = F.when(words("h1b|h-1b"), "H1B").when(words("gc|green card"), "GC").when(words("usc|us citizen"), "USC").when(words("opt"), "OPT")
    rate = F.regexp_extract(low, r"(?<![0-9])([0-9]++)[ \t]?/?[ \t]?(?:hr|hour)", 1)
    return F.struct(
        name.alias("name"), labelled_value(block, "email", "candidate email").alias("email"), labelled_value(block, "phone", "mobile").alias("phone"), title.alias("title"), _skills(block).alias("skills"),
        _found(low, r"(?<![0-9])([0-9]{1,9})\+?\s*(?:years|yrs)").try_cast("int").alias("years"),
        F.regexp_replace(F.trim(_found(block, rf"([A-Za-z][A-Za-z \t]{{1,30}},[ \t]*(?:{STATES}))\b")), r"[ \t]*,[ \t]*", ", ").alias("location"),
        visa.alias("work_authorization"), F.when(low.contains("immediate"), "Immediate").when(low.contains("2 weeks"), "2 Weeks").alias("availability"),
        F.when(rate != "", F.concat(F.lit("$"), rate, F.lit("/hr"))).alias("rate"), (place + 1).alias("source"),
    )


def hotlist(text: Column) -> Column:
    """Struct of records (CONSULTANT), record_count, confidence, requires_review and warnings of a mail with consultants.

    A table by bars comes first, then one by tabs, then blocks of labelled lines, then the whole text as
    one consultant. A blank or null text has no record and the warning no_consultants_detected. Empty
    cells are null.
    """
    held = lambda records: F.when(F.size(records) > 0, records)
    records = once(_body(text), lambda b: F.coalesce(held(_table(b, "|")), held(_table(b, "\t")), _blocks(b)))
    return _summary(records, ["no_consultants_detected"], "one_or_more_consultants_require_review")


def probable_title(x: Column) -> Column:
    """The job title that a text starts with, after words of asking; null unless it names a kind of work."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), ASKING, "")
    title = F.regexp_replace(F.regexp_extract(clean, TITLED, 1), r"^[ ,-]+|(?<![ ,-])[ ,-]+$|\.+$", "")
    return F.when(F.lower(title).rlike(TITLE_WORDS), title)


def _sections(body: Column) -> Column:
    """A requirement's positions as texts: at labels of different titles, else at numbered titles, else the whole."""
    labelled = lambda pieces: once(F.transform(pieces, lambda p: F.when(p.rlike(f"(?i)^{POSITION}"), _value(p))), lambda v: _at_titles(pieces, v))
    numbered = lambda pieces: once(_marks(F.transform(pieces, lambda p: probable_title(_found(p, rf"^{NUMBERED}[ \t]*([^\n]+)")))), lambda s: _at_numbers(pieces, s))
    several = lambda sections: F.when(F.size(sections) > 1, sections)
    return F.coalesce(several(once(_pieces(body, POSITION), labelled)), several(once(_pieces(body, NUMBERED), numbered)), F.array(body))


def _value(piece: Column) -> Column:
    """A label's value as a title in lower case: the rest of its line, or the first of three more lines that isn't blank; null if it's none."""
    lines = F.slice(F.split(F.regexp_replace(piece, f"(?i)^{POSITION}", ""), "\n"), 1, 4)
    clean = F.transform(lines, lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, r"^[ \t:-]+|(?<![ \t:-])[ \t:-]+$", ""), r"\s+", " ")))
    value = F.get(F.filter(clean, lambda s: s != ""), F.lit(0))
    return F.when(probable_title(value).isNotNull() & (F.length(value) <= LONGEST_TITLE), value)


def _marks(values: Column) -> Column:
    """Places from 0 of the values that aren't null."""
    return F.array_compact(F.transform(values, lambda v, i: F.when(v.isNotNull(), i)))


def _at_titles(pieces: Column, values: Column) -> Column:
    """Sections from each title that differs from the one before it."""

    def of(places: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))))
        return _joined(pieces, F.array_compact(F.zip_with(places, F.slice(before, F.lit(1), F.size(places)), lambda at, last: F.when((last < 0) | (F.get(values, at) != F.get(values, last)), at))))

    return F.when(F.size(F.array_compact(values)) > 1, once(_marks(values), of))


def _at_numbers(pieces: Column, starts: Column) -> Column:
    """Sections from each numbered title, if the first is 1 and no heading of duties stands right above it."""
    first = F.get(starts, F.lit(0))
    above = F.get(F.filter(F.reverse(F.split(F.array_join(F.slice(pieces, F.lit(1), first), ""), "\n")), lambda s: F.trim(s) != ""), F.lit(0))
    listed = F.regexp_extract(F.get(pieces, first), r"^[ \t]*([0-9]+)", 1) == "1"
    return F.when((F.size(starts) > 1) & listed & ~F.coalesce(above.rlike(DUTIES), F.lit(False)), _joined(pieces, starts))


def _own(body: Column) -> Column:
    """The text without the preamble above and the footer or sign-off below; the whole text if nothing is left."""
    lines = F.split(body, "\n")
    first = F.array_position(F.transform(lines, lambda s: (F.trim(s) != "") & ~s.rlike(PREAMBLE)), F.lit(True)).cast("int")
    top = _stripped(F.when(first > 0, F.array_join(F.slice(lines, first, F.size(lines)), "\n")).otherwise(""))

    def cut(t: Column) -> Column:
        places = F.array(*[F.locate(m, F.lower(t)) for m in FOOTERS], F.regexp_instr(t, F.lit("(?m)" + SIGN_OFF)))
        end = F.array_min(F.filter(places, lambda p: p > 0))
        return F.coalesce(F.nullif(_stripped(F.substring(t, F.lit(1), F.coalesce(end - 1, F.length(t)))), F.lit("")), F.nullif(t, F.lit("")), body)

    return once(top, cut)


def _position(section: Column, place: Column, subject: Column) -> Column:
    plausible = lambda t: F.when((F.length(t) >= 3) & t.rlike("[A-Za-z]"), t)
    below = lambda labels: _found(section, rf"(?im)^[ \t]*(?:{labels})[ \t]*[:\-][ \t]*(?:\n[ \t]*){{0,3}}(\S.*?)[ \t]*$")
    numbered = probable_title(_found(section, rf"^{NUMBERED}[ \t]*([^\n]+)"))
    headed = _found(section, HEADED)
    title = F.coalesce(plausible(below("job title|position|role|role name")), plausible(below("title")), plausible(numbered), F.when(probable_title(headed).isNotNull(), headed), probable_title(section), F.when(place == 0, subject))
    company = F.nullif(F.regexp_replace(F.regexp_extract(section, COMPANY, 1), r"^[ .,-]+|(?<![ .,-])[ .,-]+$", ""), F.lit(""))
    listed = labelled_value(section, *[w.lower() for w in WANTED])
    rate = F.trim(_found(section, r"(?i)(?:rate|salary|pay)[ \t]*[:\-]?[ \t]*(\$?[0-9]{2,4}(?:[ \t]*-[ \t]*\$?[0-9]{2,4})?[ \t]*(?:/hr|per hour|hourly|hr|k|per year|yearly|annually)?)"))
    held = F.struct(title.alias("title"), company.alias("company"), listed.alias("listed"), _skills(section).alias("known"), extract.location(section).alias("location"))

    def of(v: Column) -> Column:
        evidence = v["listed"].isNotNull() | ((F.size(v["known"]) > 0) & (F.length(section) >= LEAST_TEXT))
        skills = F.when(v["listed"].isNotNull(), split_list(v["listed"])).otherwise(v["known"])
        return F.struct(v["title"].alias("job_title"), section.alias("job_description"), v["company"].alias("company"), skills.alias("skills"), extract.years_of_experience(section).alias("years"), v["location"].alias("location"), extract.work_authorization(section).alias("work_authorization"), extract.employment_type(section).alias("employment_type"), rate.alias("rate"), (place + 1).alias("source"), evidence.alias("evidence"))

    return once(held, of)


def _scored(job: Column, company: Column, location: Column) -> Column:
    """A position's record; company and location of the mail's other positions where it has none."""
    company, titled, evidence = F.coalesce(job["company"], company), job["job_title"].isNotNull(), job["evidence"]
    sure = extract.requirement_confidence(titled, evidence, company.isNotNull())
    warnings = F.array_compact(F.array(F.when(~titled, F.lit("job_title_missing")), F.when(~evidence, F.lit("required_skills_not_identified")), F.when(company.isNull(), F.lit("company_missing"))))
    return F.struct(
        job["job_title"].alias("job_title"), job["job_description"].alias("job_description"), company.alias("company"), job["skills"].alias("skills"), job["years"].alias("years"), F.coalesce(job["location"], location).alias("location"),
        *[job[f].alias(f) for f in ("work_authorization", "employment_type", "rate", "source")], sure.alias("parse_confidence"), (sure < REVIEW).alias("requires_review"), warnings.alias("warnings"),
    ).cast(f"struct<{as_fields(JOB)}>")


def requirement(text: Column) -> Column:
    """Struct of records (JOB), record_count, confidence, requires_review and warnings of a mail with positions.

    Positions start at labels that state different titles, or at numbered titles; a position without a
    company or place has the first that another states. A blank or null text has no record, asks for
    review and warns no_requirements_detected.
    """

    def of(body: Column) -> Column:
        subject = probable_title(extract.subject(text))
        jobs = F.transform(_sections(_own(body)), lambda s, i: _position(s, i, subject))
        first = lambda jobs, f: F.get(F.array_compact(F.transform(jobs, lambda j: j[f])), F.lit(0))
        scored = lambda jobs: once(F.struct(first(jobs, "company").alias("c"), first(jobs, "location").alias("l")), lambda s: F.transform(jobs, lambda j: _scored(j, s["c"], s["l"])))
        return F.when(body != "", once(jobs, scored)).otherwise(F.array().cast(f"array<struct<{as_fields(JOB)}>>"))

    return _summary(once(_body(text), of), ["no_requirements_detected"], "one_or_more_requirements_require_review")


def business_records(text: Column, kind: Column) -> Column:
    """What the parser of a kind reads: struct of document_kind, consultants, positions (the other one empty), record_count, confidence, requires_review, warnings.

    Kinds other than hotlist and job_description, null included, have neither and the warning unsupported_email_document_kind.
    """
    none = lambda fields: F.array().cast(f"array<struct<{as_fields(fields)}>>")
    rest = ("record_count", "confidence", "requires_review", "warnings")
    made = lambda r, consultants, positions: F.struct(kind.alias("document_kind"), consultants.alias("consultants"), positions.alias("positions"), *[r[f].alias(f) for f in rest])
    other = F.struct(kind.alias("document_kind"), none(CONSULTANT).alias("consultants"), none(JOB).alias("positions"), F.lit(0).alias("record_count"), F.lit(0.0).alias("confidence"), F.lit(True).alias("requires_review"), F.array(F.lit("unsupported_email_document_kind")).alias("warnings"))
    hot: Callable[[Column], Column] = lambda r: made(r, r["records"], none(JOB))
    job: Callable[[Column], Column] = lambda r: made(r, none(CONSULTANT), r["records"])
    return F.when(kind == "hotlist", once(hotlist(text), hot)).when(kind == "job_description", once(requirement(text), job)).otherwise(other)


def likely_kind(text: Column) -> Column:
    """The kind whose parser is sure enough and surer than the other, else unknown."""
    return extract.document_kind(requirement(text)["confidence"], hotlist(text)["confidence"])

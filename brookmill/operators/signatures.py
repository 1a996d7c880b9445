"""Signatures of mails: where the sender's own block of lines lies, and whom it names.

A mail is an array of lines within its row, so finding the block needs no shuffle. A block lies, in
this order: where a relay names the poster at the top; below the first sign-off; right below the
header of a mail that is nothing but a forward; in the last lines, if two of them look like contact
details; at a note of the device. Quoted history and disclaimers don't count.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions.text import corporate_domain, email_domain, name_parts, once

from .extract import EMAIL

# Patterns of borders, of lines that tell a signature, and of its fields.
FORWARDED = r"(?iU)-{2,}\s*(?:forwarded message|original message)\s*-{2,}"
HEADER_BLOCK = r"(?imdU)^\s*from\s*:\s*.+\n\s*(?:sent|date)\s*:\s*.+"
REPLY_HEADER = r"(?iU)^\s*on\s+.{0,160}\s+wrote:\s*$"
QUOTED = r"(?U)^\s*>"
HEADER_LINE = r"(?iU)^\s*(?:from|sent|date|to|subject|cc|bcc)\s*:"
RELAY = (
    r"(?im)^[ \t]*from[ \t]*:[ \t]*\n(?:[ \t]*\n){0,3}"
    r"[ \t]*([^\n,]{1,60}),[ \t]*\n(?:[ \t]*\n){0,3}"
    r"[ \t]*([^\n]{1,80}?)[ \t]*\n(?:[ \t]*\n){0,3}"
    r"[ \t]*([^\s@]+@[^\s@]+\.[a-zA-Z]{2,})[ \t]*$"
)
SIGN_OFF = (
    r"(?i)^[ \t>]*(?:-{2,}|thanks(?:[ \t]+(?:so much|again|(?:&|and)[ \t]+regards))?|thank you|"
    r"regards|best regards|kind regards|warm regards|warmest regards|best|sincerely|cheers|respectfully)[ \t]*[,.!]?[ \t]*$"
)
DEVICE = r"(?iU)^\s*sent from my (?:iphone|ipad|android|samsung(?:\s+device)?|mobile device|blackberry)\s*\.?\s*$"
DISCLAIMER = (
    r"(?iU)^\s*(?:this\s+(?:e-?mail|message|transmission|communication)\b.{0,160}(?:confidential|privileged|intended (?:solely|only) for)"
    r"|confidentiality notice|if you (?:are not|have received this)\b.{0,160}(?:intended recipient|in error)"
    r"|to\s+unsubscribe\b|click here to unsubscribe|manage your (?:email )?preferences|update your (?:email )?preferences"
    r"|you are receiving this (?:email|message) because|this email was sent to\b)"
)
SOCIAL = r"(?i)\b(?:follow us on|find us on|connect with us on|like us on)\b"
TRACKING = r"(?i)https?://(?:[\w-]+\.)*(?:list-manage\.com|mailchi\.mp|sendgrid\.net|hubspotlinks\.com|mandrillapp\.com|constantcontact\.com|campaign-archive\.com|click\.[\w.-]+)"
RELAY_URL = r"(?i)https?://(?:[\w-]+\.)*(?:nvoids\.com|prohirespowerhouse\.com)"
URL = r"(?i)\b(?:https?://|www\.)[\w.-]+\.[a-z]{2,}(?:/[^\s<>\"']*)?"
TITLE = (
    r"(?i)\b(?:senior|sr\.?|junior|jr\.?)?\s*(?:technical )?recruiter\b|\btalent (?:acquisition|sourcer)\b|\bsourcer\b|"
    r"\baccount (?:manager|executive)\b|\bhuman resources\b|\bhr\b|\bdirector\b|\bmanager\b|\bengineer\b|\bconsultant\b|\bspecialist\b|"
    r"\bcoordinator\b|\banalyst\b|\bexecutive\b|\bofficer\b|\blead\b|\bpresident\b|\bceo\b|\bcto\b|\bcfo\b|\bvp\b|\bvice president\b|"
    r"\bstaffing\b|\bdelivery (?:manager|lead)\b|\bbusiness development\b|\bbench sales\b"
)
COMPANY = r"(?i)\b(?:inc\.?|llc\.?|llp\.?|ltd\.?|corp\.?|corporation|staffing|solutions|technologies|technology|systems|group|consulting|services)\b"
NAME = r"^[A-Z][a-zA-Z'.\-]+(?:\s+[A-Z][a-zA-Z'.\-]+){1,3}$"
BOILERPLATE = r"(?i)^(?:keywords:|view this job online|happy recruiting|free resume and job search portal|you received this email from)"
CITY_STATE = r"\b([A-Z][a-zA-Z. ]{1,30}?),\s*([A-Z]{2})\b(?:\s+(\d{5})(?:-\d{4})?)?"
MOBILE_LABEL = r"\b(?:mobile|cell)\s*[:\-]|(?<![a-zA-Z])m\s*[:\-]"
PHONE_LABEL = r"\b(?:phone|office|direct|tel|telephone)\s*[:\-]|(?<![a-zA-Z])[odp]\s*[:\-]"
FAX = r"(?i)\bfax\s*[:\-]"
EXTENSION = r"(?i)\b(?:ext\.?|extension|x)\s*[:\-]?\s*(\d{2,6})\b"
PHONE = r"\+[1-9]\d{0,2}[\s.-]?(?:\d[\s.-]?){6,13}\d|(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9\-_%]+/?"
#: Lines looked at, the longest line of a title or company, and the confidence below which someone looks.
TAIL, RELAY_LINES, NAME_LINES, LONGEST, REVIEW = 15, 20, 4, 80, 0.70
#: States by name.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
STATE_NAMES = rf"(?i)([A-Z][a-zA-Z. ]{{1,30}}),\s*({'|'.join(STATES)})"
#: A mail address that starts where its characters start, so that a long run is read once.
ADDRESS = "(?<![A-Za-z0-9._%+-])" + EMAIL.replace("+@", "++@")

Lines = Callable[[Column], Column]


def _first(lines: Column, holds: Lines) -> Column:
    """The first line that holds, null without one."""
    return F.get(F.filter(lines, holds), F.lit(0))


def _places(lines: Column, start: Column, stop: Column, holds: Lines) -> Column:
    """The places from 0 of the lines from start up to stop that hold."""
    here = F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))
    marked = F.transform(here, lambda s, i: F.when(holds(s), i + start))
    return F.array_compact(marked)


def _line_at(text: Column, pattern: str) -> Column:
    """The line from 0 at which the pattern's first match starts, null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def _is_signal(line: Column) -> Column:
    patterns = (ADDRESS, LINKEDIN, f"(?i){MOBILE_LABEL}|{PHONE_LABEL}", PHONE, TITLE, COMPANY, CITY_STATE)
    found = [line.rlike(p) for p in patterns]
    out = found[0]
    for more in found[1:]:
        out = out | more
    return out & ~_blank(line)


def _at(name: str) -> Column:
    """A column of the steps below. These are plain columns, not fields of structs, so that the plan keeps each step and works it out once."""
    return F.col(f"_sg_{name}")


def _with(df: DataFrame, **steps: Column) -> DataFrame:
    return df.withColumns({f"_sg_{name}": step for name, step in steps.items()})


def _with_block_start(df: DataFrame, name: str, start: Column, stop: Column) -> DataFrame:
    """df with the start of the block of two signals or more between start and stop, with the name lines above it; else null."""
    out = _with(df, signals=_places(_at("lines"), start, stop, _is_signal))
    above = _places(_at("lines"), start, F.get(_at("signals"), F.lit(0)), lambda x: ~_blank(x) & ~_stripped(x).rlike(NAME))
    out = _with(out, top=F.coalesce(F.array_max(above) + 1, start))
    filled = F.array_min(_places(_at("lines"), _at("top"), _at("end"), lambda x: ~_blank(x)))
    return _with(out, **{name: F.when(F.size(_at("signals")) >= 2, F.coalesce(filled, _at("end")))})


def _with_block(df: DataFrame, text: str, quoted: bool) -> DataFrame:
    """df with the steps up to the block: lines, start, stop (from 0, null without a block), method, signoff, relay_*, cut, ignored."""
    out = _with(df, body=F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"))
    out = _with(out, raw=F.split(_at("body"), "\n", -1), marked=_line_at(_at("body"), FORWARDED), header=_line_at(_at("body"), HEADER_BLOCK))
    reply = F.array_min(_places(_at("raw"), F.lit(0), F.size(_at("raw")), lambda x: x.rlike(REPLY_HEADER) | x.rlike(QUOTED)))
    bare = F.transform(_at("raw"), lambda x: F.regexp_replace(x, r"(?U)^\s*(?:>\s*)+", ""))
    out = _with(out, lines=bare, n=F.size(_at("raw")), border=F.coalesce(_at("marked"), _at("header"), reply))
    fresh = F.size(F.filter(F.slice(_at("raw"), F.lit(1), _at("border")), lambda x: ~_blank(x)))
    out = _with(out, forward=_at("border").isNotNull() & (fresh <= 1) & (_at("marked").isNotNull() | _at("header").isNotNull()))
    out = _with(out, end=F.when(F.lit(quoted) | _at("border").isNull() | _at("forward"), _at("n")).otherwise(_at("border")))
    below = F.coalesce(F.slice(_at("lines"), _at("border") + 1, _at("n")), F.array().cast("array<string>"))
    head = F.coalesce(F.array_min(_places(_at("lines"), _at("border"), _at("n"), lambda x: ~_blank(x) & ~x.rlike(HEADER_LINE))), _at("n"))
    out = _with(
        out,
        ignored=(_at("end") < _at("n")) & F.exists(below, lambda x: x.rlike(SIGN_OFF) | x.rlike(ADDRESS)),
        upper=F.array_join(F.slice(_at("lines"), F.lit(1), F.least(F.lit(RELAY_LINES), _at("end"))), "\n"),
        off=F.array_min(_places(_at("lines"), F.lit(0), _at("end"), lambda x: x.rlike(SIGN_OFF))),
        head=F.when(_at("forward"), head),
        tail=F.greatest(_at("end") - TAIL, F.lit(0)),
    )
    out = _with(out, relay=F.regexp_extract(_at("upper"), RELAY, 0), head_stop=F.least(_at("head") + TAIL, _at("end")))
    out = _with(out, relay_start=F.when(_at("relay") != "", _line_at(_at("upper"), RELAY)), **{f"relay_{k}": F.nullif(F.trim(F.regexp_extract(_at("relay"), RELAY, i)), F.lit("")) for i, k in enumerate(("name", "company", "email"), 1)})
    out = _with_block_start(_with_block_start(out, "structural_head", _at("head"), _at("head_stop")), "structural_tail", _at("tail"), _at("end"))
    out = _with(out, device=F.array_min(_places(_at("lines"), _at("tail"), _at("end"), lambda x: x.rlike(DEVICE))))
    kinds = [
        (_at("relay_start"), _at("relay_start") + F.size(F.split(_at("relay"), "\n", -1)), "relay_from_block"), (_at("off"), _at("end"), "signoff_marker"),
        (_at("structural_head"), _at("head_stop"), "structural"), (_at("structural_tail"), _at("end"), "structural"), (_at("device"), _at("end"), "mobile_signature_marker"),
    ]
    out = _with(
        out, start=F.coalesce(*[a for a, _, _ in kinds]), stop=F.coalesce(*[F.when(a.isNotNull(), b) for a, b, _ in kinds]),
        method=F.coalesce(*[F.when(a.isNotNull(), F.lit(m)) for a, _, m in kinds]),
    )
    out = _with(out, signoff=F.when(_at("method") == "signoff_marker", F.get(_at("lines"), _at("start"))), notice=F.array_min(_places(_at("lines"), _at("start"), _at("n"), lambda x: x.rlike(DISCLAIMER))))
    return _with(out, cut=F.coalesce(_at("notice") < _at("stop"), F.lit(False)), stop=F.least(_at("stop"), _at("notice")))


def with_spans(df: DataFrame, text: str, quoted: bool = False) -> DataFrame:
    """df with the struct span: start and stop of the block's lines (from 0, null if there is none), method, and whether a disclaimer below was cut off.

    quoted: look through quoted history as well. Null texts count as empty.
    """
    out = _with_block(df, text, quoted).withColumn("span", F.struct(_at("start").alias("start"), _at("stop").alias("stop"), _at("method").alias("method"), _at("cut").alias("disclaimer")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != "span"], "span")


def _field(value: Column, confidence: Column | float, method: str, source: Column) -> Column:
    """A found value with how sure it is, how it was found and its line; null without a value."""
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(value.isNotNull() & (value != ""), F.struct(value.alias("value"), sure.cast("double").alias("confidence"), F.lit(method).alias("method"), source.alias("source")))


_FIELD = "struct<value:string,confidence:double,method:string,source:string>"


def _title_and_company(lines: Column, name: Column) -> Column:
    """Struct of title and company: the first lines that tell one; a line that tells both is split at the first of its marks."""

    def split_at(line: Column, mark: str) -> Column:
        left = F.trim(F.substring_index(line, mark, 1))
        right = F.trim(F.substring(line, F.instr(line, mark) + len(mark), F.length(line)))
        return F.when(F.contains(line, F.lit(mark)), F.when(left.rlike(TITLE), F.struct(left.alias("t"), right.alias("c"))).otherwise(F.struct(right.alias("t"), left.alias("c"))))

    def step(acc: Column, line: Column) -> Column:
        titled, firm = line.rlike(TITLE), line.rlike(COMPANY)
        skipped = line.eqNullSafe(name) | line.rlike(BOILERPLATE) | (F.length(line) > LONGEST)
        parts = F.coalesce(*[split_at(line, mark) for mark in ("|", " - ", ",")])
        whole = lambda sure, method: _field(line, sure, method, line)
        title = F.when(titled & firm & parts.isNotNull(), _field(parts["t"], 0.85, "title_company_split", line)).when(titled, whole(F.when(firm, 0.75).otherwise(0.80), "title_keyword"))
        company = F.when(titled & firm, F.when(parts.isNotNull(), _field(parts["c"], 0.85, "title_company_split", line)).when(acc["title"].isNotNull(), whole(0.75, "company_suffix"))).when(firm, whole(0.80, "company_suffix"))
        return F.when(skipped, acc).otherwise(F.struct(F.coalesce(acc["title"], title).alias("title"), F.coalesce(acc["company"], company).alias("company")))

    none = F.lit(None).cast(_FIELD)
    return F.aggregate(lines, F.struct(none.alias("title"), none.alias("company")), step)


def e164(x: Column) -> Column:
    """A number with its country: after a `+` its 8 to 15 digits, else a valid one of North America; null for others."""
    digits = F.regexp_replace(x, r"\D", "")
    home = F.regexp_extract(digits, "^1?([2-9][0-9]{2}[2-9][0-9]{6})$", 1)
    abroad = x.startswith("+") & ~digits.startswith("1") & F.length(digits).between(8, 15)
    return F.when(abroad, F.concat(F.lit("+"), digits)).when(home != "", F.concat(F.lit("+1"), home))


def _phones(lines: Column) -> Column:
    """Struct of phone, mobile and extension: labelled numbers first come first served, others in the first of both that is free; no fax."""
    kept = F.filter(lines, lambda s: ~s.rlike(FAX) & s.rlike(PHONE))

    def numbers(line: Column) -> Column:
        def one(number: Column) -> Column:
            before = F.nullif(F.call_function("substring_index", line, number, F.lit(1)), F.lit(""))
            label = F.lower(F.regexp_extract(F.coalesce(before, line), f"(?i){MOBILE_LABEL}|{PHONE_LABEL}", 0))
            kind = F.when(label == "", "any").when(label.rlike(MOBILE_LABEL), "mobile").otherwise("phone")
            valid = e164(number)
            sure = F.when(valid.isNotNull(), F.when(label == "", 0.90).otherwise(0.97)).otherwise(0.55)
            extension = F.nullif(F.regexp_extract(line, EXTENSION, 1), F.lit(""))
            return F.struct(kind.alias("kind"), F.struct(valid.alias("value"), sure.alias("confidence"), number.alias("raw"), line.alias("source"), extension.alias("extension")).alias("of"))

        return F.transform(F.regexp_extract_all(line, F.lit(f"({PHONE})"), 1), lambda number: one(F.trim(number)))

    none = F.lit(None).cast("struct<value:string,confidence:double,raw:string,source:string,extension:string>")

    def step(acc: Column, x: Column) -> Column:
        phone, mobile = acc["phone"], acc["mobile"]
        as_phone = phone.isNull() & (x["kind"] != "mobile")
        as_mobile = mobile.isNull() & ((x["kind"] == "mobile") | ((x["kind"] == "any") & phone.isNotNull()))
        return F.struct(F.when(as_phone, x["of"]).otherwise(phone).alias("phone"), F.when(as_mobile, x["of"]).otherwise(mobile).alias("mobile"))

    return F.aggregate(F.flatten(F.transform(kept, numbers)), F.struct(none.alias("phone"), none.alias("mobile")), step)


def _url(x: Column) -> Column:
    bare = F.regexp_replace(F.trim(x), "/+$", "")
    return F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def _location(lines: Column) -> Column:
    """Struct of city, state and postal_code, out of `City, ST 12345` or `City, State`."""
    states = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])

    def of(line: Column) -> Column:
        part = lambda i: F.nullif(F.trim(F.regexp_extract(line, CITY_STATE, i)), F.lit(""))
        short = F.when(line.rlike(CITY_STATE), F.struct(part(1).alias("city"), part(2).alias("state"), part(3).alias("postal_code"), F.lit(0.80).alias("confidence")))
        named = F.struct(F.trim(F.regexp_extract(line, STATE_NAMES, 1)).alias("city"), F.try_element_at(states, F.lower(F.regexp_extract(line, STATE_NAMES, 2))).alias("state"), F.lit(None).cast("string").alias("postal_code"), F.lit(0.75).alias("confidence"))
        return F.coalesce(short, F.when(line.rlike(STATE_NAMES), named))

    return once(_first(lines, lambda s: s.rlike(CITY_STATE) | s.rlike(STATE_NAMES)), of)


def signatures(df: DataFrame, text: str, sender: str | None = None, quoted: bool = False) -> DataFrame:
    """df with the struct signature of each mail; sender: the column of the address it came from.

    detected, method, raw (the block), contact (name, first, middle and last name, title, company,
    email, phone, mobile, linkedin, website, location), confidence (0.92 with a name, a way to reach
    the sender, and a title or company; 0.70 with two of these, 0.45 with one), requires_review,
    sender_email, signature_email (if it is another than the sender's), quoted_ignored, warnings.
    Without a block the contact is empty and the confidence 0. Numbers count as valid by their form.
    """
    whence = F.lower(F.trim(F.col(sender))) if sender else F.lit(None).cast("string")
    out = _with(_with_block(df, text, quoted), whence=whence)
    size = F.greatest(_at("stop") - _at("start"), F.lit(0))
    out = _with(out, block=F.coalesce(F.slice(_at("lines"), _at("start") + 1, size), F.array().cast("array<string>")))
    out = _with(out, content=F.filter(F.transform(_at("block"), _stripped), lambda x: (x != "") & ~x.rlike(SIGN_OFF) & ~x.rlike(DEVICE) & ~x.rlike(SOCIAL) & ~x.rlike(TRACKING)))
    content, relayed = _at("content"), _at("relay_name").isNotNull()
    out = _with(
        out,
        named=_first(F.slice(content, 1, NAME_LINES), lambda x: x.rlike(NAME)),
        mailed=_first(content, lambda x: x.rlike(ADDRESS)),
        linked=_first(content, lambda x: x.rlike(LINKEDIN)),
        sited=_first(content, lambda x: x.rlike(URL) & ~x.rlike(LINKEDIN) & ~x.rlike(RELAY_URL)),
        phones=_phones(content),
        location=_location(content),
        home=F.when(_at("method").isNotNull(), corporate_domain(email_domain(_at("whence")))),
    )
    by_relay = lambda k: _field(_at(f"relay_{k}"), 0.90, "relay_from_block", _at(f"relay_{k}"))
    by_line = F.when(_at("signoff").isNotNull(), _field(_at("named"), 0.90, "signoff_next_line", _at("named"))).otherwise(_field(_at("named"), 0.75, "structural_first_line", _at("named")))
    out = _with(out, name=F.when(relayed, by_relay("name")).otherwise(by_line), address=F.regexp_replace(F.lower(F.regexp_extract(_at("mailed"), ADDRESS, 0)), "^[.%+-]+", ""))
    out = _with(
        out,
        roles=_title_and_company(content, _at("name.value")),
        email=_field(_at("address"), 0.98, "email_regex", _at("mailed")),
        linkedin=_field(F.substring_index(_url(F.regexp_extract(_at("linked"), LINKEDIN, 0)), "?", 1), 0.95, "linkedin_regex", _at("linked")),
        website=F.coalesce(_field(_url(F.regexp_extract(_at("sited"), URL, 0)), 0.90, "url_regex", _at("sited")), _field(F.concat(F.lit("https://"), _at("home")), 0.6, "derived_from_sender_domain", _at("whence"))),
        parts=F.when(_at("name").isNotNull(), name_parts(_at("name.value"))),
    )
    out = _with(out, title=F.when(~relayed, _at("roles.title")), company=F.when(relayed, by_relay("company")).otherwise(_at("roles.company")), phone=_at("phones.phone"), mobile=_at("phones.mobile"))
    known = lambda name: _at(name).isNotNull()
    reached = known("email") | known("phone") | known("mobile")
    signals = sum((x.cast("int") for x in (known("name"), reached, known("company") | known("title"))), F.lit(0))
    out = _with(out, signals=signals, other=F.when(_at("email.value") != _at("whence"), _at("email.value")))
    sure = F.when(_at("signals") >= 3, 0.92).when(_at("signals") == 2, 0.70).when(_at("signals") == 1, 0.45).otherwise(0.0)
    detected = _at("method").isNotNull()
    lacking = lambda name, there: F.when(~there, F.lit(f"{name}_not_detected"))
    only_device = (_at("method") == "mobile_signature_marker") & ~known("name") & ~reached
    warnings = F.array_compact(F.array(
        *[lacking(k, known(k)) for k in ("name", "title", "company", "email")], lacking("phone", known("phone") | known("mobile")),
        F.when(only_device, F.lit("mobile_signature_marker_only")), F.when(known("other"), F.lit("signature_email_differs_from_sender")), F.when(_at("cut"), F.lit("disclaimer_removed")),
    ))
    contact = F.struct(
        _at("name").alias("name"), *[_at(f"parts.{k}").alias(f"{k}_name") for k in ("first", "middle", "last")],
        *[_at(k).alias(k) for k in ("title", "company", "email", "phone", "mobile", "linkedin", "website", "location")],
    )
    made = F.struct(
        detected.alias("detected"), _at("method").alias("method"), _stripped(F.array_join(_at("block"), "\n")).alias("raw"), contact.alias("contact"), sure.alias("confidence"), (sure < REVIEW).alias("requires_review"),
        _at("whence").alias("sender_email"), _at("other").alias("signature_email"), _at("ignored").alias("quoted_ignored"), F.when(detected, warnings).otherwise(F.array(F.lit("signature_not_detected"))).alias("warnings"),
    )
    return out.withColumn("signature", made).select(*[F.col(f"`{c}`") for c in df.columns if c != "signature"], "signature")

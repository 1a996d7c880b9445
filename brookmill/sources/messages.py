"""Provider payloads as rows of one message schema: channel, source_message_id, sender_email, sender_name, text, received_at."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions.text import addresses, base64url, strip_html

COLUMNS = ("channel", "source_message_id", "sender_email", "sender_name", "text", "received_at")

#: Levels of MIME parts within parts that are read.
MIME_LEVELS = 10


def _message(df: DataFrame, channel: str, message_id: Column, email: Column, name: Column, text: Column, at: Column) -> DataFrame:
    values = (F.lit(channel), message_id.cast("string"), F.lower(email), name, F.coalesce(text, F.lit("")), at.cast("timestamp"))
    return df.select(*[v.alias(c) for v, c in zip(values, COLUMNS)])


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def email_webhook(df: DataFrame) -> DataFrame:
    """payload: JSON with from, subject, text or html, message_id, date."""
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    body = _first(j("text"), j("body"), strip_html(j("html")))
    text = F.concat_ws("\n", F.concat(F.lit("Subject: "), F.nullif(j("subject"), F.lit(""))), body)
    return _message(df, "email", _first(j("message_id"), j("id")), F.get(addresses(j("from")), F.lit(0)), F.nullif(F.trim(F.regexp_extract(j("from"), r"^([^<]+)<", 1)), F.lit("")), text, j("date"))


def _part(levels: int, extra: str = "") -> str:
    """The type of a MIME part with so many levels of parts below it."""
    below = f",parts:array<{_part(levels - 1)}>" if levels else ""
    return f"struct<mimeType:string,body:struct<data:string>{extra}{below}>"


def mime_text(part: Column, levels: int) -> Column:
    """The text of a MIME part, null if there is none: its own if it is plain, else the first text among its plain parts,
    then among all its parts, depth first, else whatever its body holds."""
    own = F.nullif(base64url(part["body"]["data"]), F.lit(""))
    if not levels:
        return own
    parts = part["parts"]
    below = F.concat(F.filter(parts, lambda p: p["mimeType"] == "text/plain"), F.filter(parts, lambda p: ~p["mimeType"].eqNullSafe("text/plain")))
    first = F.get(F.filter(F.transform(below, lambda p: mime_text(p, levels - 1)), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(F.when(part["mimeType"] == "text/plain", own), first, own)


def gmail(df: DataFrame, levels: int = MIME_LEVELS) -> DataFrame:
    """payload: a message with headers and a tree of MIME parts, bodies in base64; levels: how deep the tree is read. Without any text, the snippet counts."""
    m = df.select(F.from_json("payload", f"struct<id:string,internalDate:string,snippet:string,payload:{_part(levels, ',headers:array<struct<name:string,value:string>>')}>").alias("m"))
    header = lambda n: F.get(F.filter("m.payload.headers", lambda h: F.lower(h["name"]) == n), F.lit(0))["value"]
    text = F.coalesce(mime_text(F.col("m.payload"), levels), F.col("m.snippet"))
    return _message(m, "gmail", F.col("m.id"), F.get(addresses(header("from")), F.lit(0)), F.nullif(F.trim(F.regexp_extract(header("from"), r"^([^<]+)<", 1)), F.lit("")), text, F.timestamp_millis(F.col("m.internalDate").try_cast("long")))


def push_envelope(df: DataFrame) -> DataFrame:
    """email and history_id out of a push notification's base64 data."""
    data = base64url(F.get_json_object("payload", "$.message.data"))
    return df.select(F.get_json_object(data, "$.emailAddress").alias("email"), F.get_json_object(data, "$.historyId").try_cast("long").alias("history_id"))


def graph(df: DataFrame) -> DataFrame:
    """payload: a message with from.emailAddress and an HTML or text body."""
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    body = F.when(F.lower(j("body.contentType")) == "html", strip_html(j("body.content"))).otherwise(j("body.content"))
    text = F.concat_ws("\n", F.concat(F.lit("Subject: "), F.nullif(j("subject"), F.lit(""))), body)
    return _message(df, "outlook", j("id"), j("from.emailAddress.address"), j("from.emailAddress.name"), text, j("receivedDateTime"))


def chat(df: DataFrame, channel: str, message_id: str, email: str, name: str, text: str, at: str) -> DataFrame:
    """payload of a chat service, by the JSON paths of its fields; times may be seconds since 1970."""
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    when = F.coalesce(F.timestamp_seconds(j(at).try_cast("double")), j(at).try_cast("timestamp"))
    return _message(df, channel, j(message_id), j(email), j(name), j(text), when)


slack = functools.partial(chat, channel="slack", message_id="event.client_msg_id", email="event.user_email", name="event.user", text="event.text", at="event.ts")
teams = functools.partial(chat, channel="teams", message_id="id", email="from.user.email", name="from.user.displayName", text="body.content", at="createdDateTime")
google_chat = functools.partial(chat, channel="google_chat", message_id="message.name", email="message.sender.email", name="message.sender.displayName", text="message.text", at="message.createTime")
whatsapp = functools.partial(chat, channel="whatsapp", message_id="messages[0].id", email="contacts[0].email", name="contacts[0].profile.name", text="messages[0].text.body", at="messages[0].timestamp")
telegram = functools.partial(chat, channel="telegram", message_id="message.message_id", email="message.from.email", name="message.from.username", text="message.text", at="message.date")


def together(*sources: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), sources)


def duplicate_key(channel: Column, message_id: Column) -> Column:
    return F.concat_ws(":", channel, message_id)


def mailbox_kind(recipients: Column, boxes: dict[str, str]) -> Column:
    """The kind of the mailboxes among the recipients if they are of exactly one; boxes: address to kind."""
    known = F.create_map(*[F.lit(x) for kv in boxes.items() for x in kv])
    kinds = F.array_distinct(F.array_compact(F.transform(addresses(recipients), lambda a: F.try_element_at(known, a))))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))

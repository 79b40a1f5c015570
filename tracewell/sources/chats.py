"""Chat sources: messenger export, capture buffer, pasted text. Each gives normalised messages in source order."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import rich_text, truthy
from tracewell.operators.ingest import forward_authorship
from tracewell.operators.ranking import running
from tracewell.sources.paths import Folder

#: Field names of the formats.
EXPORT = "name string, id string, messages array<struct<id:string,type:string,date:string,`from`:string,actor:string,forwarded_from:string,text:string,file:string,photo:string,media_type:string,reply_to_message_id:string>>"
CAPTURE = (
    "chat_id string, message_id string, chat_slug string, date string, author_name string, text string, origin_type string, origin_name string,"
    " media_kind string, file_id string, file_name string, local_path string, reply_to string, reply_context string"
)
REQUIRED = ("chat_id", "message_id", "chat_slug", "date", "author_name")
MARKERS = ("chat_slug", "message_id", "origin_type", "file_id")
STAMP = r"^\[([0-9]{2})\.([0-9]{2})\.([0-9]{4}) ([0-9]{2}:[0-9]{2})(:[0-9]{2})?\] ?(.*)$"
NO_TEXT = "[no text: the paste held only a file]"
COLUMNS = ("pos", "date", "author", "text", "via", "media", "media_kind", "msg_id", "reply_to", "attribution", "shown_as", "source_id")
NAME_CHARS = 60
HEAD_LINES = 40


def detect(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(format, file) of a source: ``export``, ``capture`` or ``paste``; None for anything else.

    Files are read in a task each; the driver learns only what they are.
    """
    folder = Folder(spark, path)
    inside = folder.is_folder()
    if not folder.exists():
        return None
    for name in ("result.json", "inbox.json"):
        if inside and not folder.exists(name):
            continue
        file = folder.at(name) if inside else path
        keys = F.json_object_keys(F.get_json_object(_rows(), "$[0]"))
        captured = F.coalesce(F.forall(F.array(*map(F.lit, REQUIRED)), lambda k: F.array_contains(keys, k)), F.lit(False))
        listed = F.coalesce(F.get_json_object("value", "$.messages").startswith("["), F.lit(False))
        found = spark.read.text(file, wholetext=True).select(captured.alias("captured"), listed.alias("listed")).first()
        if found and found.captured:
            return "capture", file
        if found and found.listed:
            return "export", file
    if not inside and os.path.splitext(path)[1] in (".txt", ".md", ""):
        head = F.slice(F.split("value", "\n"), 1, HEAD_LINES)
        found = spark.read.text(path, wholetext=True).select(F.exists(head, lambda x: F.regexp_like(x, F.lit(STAMP))).alias("stamped")).first()
        if found and found.stamped:
            return "paste", path
    return None


def _rows() -> Column:
    """The list of messages of a document: its own, or the whole."""
    return F.coalesce(F.get_json_object("value", "$.messages"), F.col("value"))


def missing_keys(rows: list) -> list[str]:
    """Required fields that the first row of something like a capture buffer lacks; none if it is not like one."""
    head = set(rows[0]) if rows and isinstance(rows[0], dict) else set()
    alike = head & set(MARKERS) and len(head & set(REQUIRED)) >= 2
    return sorted(set(REQUIRED) - head) if alike else []


def parse_export(documents: DataFrame) -> DataFrame:
    """Messages of messenger exports given as JSON texts (value)."""
    parsed = documents.select(F.from_json("value", EXPORT).alias("d")).where("d is not null")
    rows = parsed.select(F.col("d.id").alias("chat"), F.posexplode("d.messages").alias("pos", "m")).where("m.type = 'message'")
    sender = F.coalesce(F.nullif(F.col("m.from"), F.lit("")), F.nullif(F.col("m.actor"), F.lit("")), F.lit("unknown"))
    other = truthy(F.col("m.forwarded_from")) & (F.col("m.forwarded_from") != sender)
    media = F.coalesce(F.nullif(F.col("m.file"), F.lit("")), F.nullif(F.col("m.photo"), F.lit("")))
    kind = F.when(media.isNull(), F.lit(None)).when(truthy(F.col("m.photo")) & ~truthy(F.col("m.file")), "photo").when(F.col("m.media_type").isin("voice_message", "video_message", "audio_file"), "voice").otherwise("document")
    return rows.select(
        "pos", F.col("m.date").alias("date"), F.when(other, F.col("m.forwarded_from")).otherwise(sender).alias("author"), rich_text(F.col("m.text")).alias("text"), F.when(other, sender).alias("via"),
        media.alias("media"), kind.alias("media_kind"), F.col("m.id").alias("msg_id"), F.col("m.reply_to_message_id").alias("reply_to"), F.lit("reliable").alias("attribution"),
        F.lit(None).cast("string").alias("shown_as"), F.concat(F.lit("tg"), F.col("chat")).alias("source_id"),
    )


def parse_capture(rows: DataFrame) -> DataFrame:
    """Messages of capture buffers given as one JSON object per row (value, pos).

    A file that was announced but not stored gets the path where it is expected. A buffer of several chats is an error.
    """
    parsed = rows.select("pos", F.from_json("value", CAPTURE).alias("m")).where("m is not null")
    chats = parsed.agg(F.min("m.chat_slug").alias("a"), F.max("m.chat_slug").alias("b")).first()
    if chats and chats.a != chats.b:
        raise ValueError(f"a capture buffer holds one chat, this one holds {chats.a} and {chats.b}")
    who = forward_authorship(F.col("m.origin_type"), F.col("m.origin_name"), F.col("m.author_name"))
    expected = F.concat_ws("/", F.lit("files"), "m.chat_slug", F.concat_ws("_", "m.message_id", F.coalesce("m.file_name", F.lit("file"))))
    media = F.coalesce(F.nullif(F.col("m.local_path"), F.lit("")), F.when(truthy(F.col("m.file_id")), expected))
    kind = F.when(media.isNull(), F.lit(None)).when(F.col("m.media_kind").isin("voice", "audio", "video_note"), "voice").when(F.col("m.media_kind") == "photo", "photo").otherwise("document")
    return parsed.withColumn("_w", who).select(
        "pos", F.col("m.date").alias("date"), F.col("_w.author").alias("author"), F.coalesce("m.text", F.lit("")).alias("text"), F.col("_w.via").alias("via"), media.alias("media"), kind.alias("media_kind"),
        F.concat_ws(":", "m.chat_slug", "m.message_id").alias("msg_id"), F.col("m.reply_to").alias("reply_to"), F.col("_w.attribution").alias("attribution"), F.col("_w.shown_as").alias("shown_as"),
        F.concat(F.lit("capture:"), F.col("m.chat_slug")).alias("source_id"),
    )


def paste_segments(lines: DataFrame) -> DataFrame:
    """(source, pos, date, rest, text): pasted messages from lines (source, line_no, value).

    A line with a stamp begins a message, other lines go on with it; lines before the first stamp are dropped. Which
    message a line belongs to is the running number of stamps, found without gathering a source in one task.
    """
    stamped = lines.select("source", "line_no", "value", F.regexp_like("value", F.lit(STAMP)).cast("int").alias("_head"))
    parts = running(stamped, ["source"], ["line_no"], F.col("_head"), "pos").where("pos > 0")
    part = lambda i: F.regexp_extract("value", STAMP, i)
    stamp = F.concat(part(3), F.lit("-"), part(2), F.lit("-"), part(1), F.lit("T"), part(4), F.when(part(5) != "", part(5)).otherwise(F.lit(":00")))
    rows = parts.select("source", "pos", "line_no", F.when(F.col("_head") == 1, stamp).alias("date"), F.when(F.col("_head") == 1, part(6)).alias("rest"), F.when(F.col("_head") == 0, F.col("value")).alias("more"))
    grouped = rows.groupBy("source", "pos").agg(F.max("date").alias("date"), F.max("rest").alias("rest"), F.array_sort(F.collect_list(F.when(F.col("more").isNotNull(), F.struct("line_no", "more")))).alias("_m"))
    return grouped.select("source", "pos", "date", "rest", F.array_join(F.transform("_m", lambda x: x["more"]), "\n").alias("more"))


def paste_splits(segments: DataFrame) -> DataFrame:
    """(source, pos, opt, author, body): every way to part the first line into name and text, at a colon."""
    parts = F.split("rest", ":")
    cut = F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")))
    options = segments.select("source", "pos", "rest", cut.alias("opt"))
    author = F.trim(F.array_join(F.slice(F.split("rest", ":"), 1, F.col("opt")), ":"))
    body = F.array_join(F.slice(F.split("rest", ":"), F.col("opt") + 1, F.lit(1 << 20)), ":")
    shaped = options.select("source", "pos", "opt", author.alias("author"), body.alias("body"))
    return shaped.where((F.col("author") != "") & (F.length("author") <= NAME_CHARS) & F.regexp_like("body", F.lit(r"^( |$)")))


def paste_authors(splits: DataFrame) -> DataFrame:
    """(source, pos, author, body): the way to part a line whose name is the most frequent of all, then the shortest."""
    votes = splits.groupBy("source", "author").agg(F.count("*").alias("votes"))
    best = F.max_by(F.struct("author", "body"), F.struct("votes", -F.length("author"), -F.col("opt"))).alias("_b")
    return splits.join(votes, ["source", "author"]).groupBy("source", "pos").agg(best).select("source", "pos", "_b.author", F.trim("_b.body").alias("body"))


def parse_paste(lines: DataFrame) -> DataFrame:
    """Messages of pasted texts (source, line_no, value)."""
    segments = paste_segments(lines)
    named = paste_authors(paste_splits(segments))
    rows = segments.join(named, ["source", "pos"], "left")
    text = F.trim(F.concat_ws("\n", F.coalesce("body", "rest"), F.nullif(F.col("more"), F.lit(""))))
    none = F.lit(None).cast("string")
    return rows.select(
        "pos", "date", F.coalesce("author", F.lit("unknown")).alias("author"), F.when(text == "", F.lit(NO_TEXT)).otherwise(text).alias("text"), none.alias("via"), none.alias("media"),
        F.when(text == "", "document").alias("media_kind"), none.alias("msg_id"), none.alias("reply_to"), F.lit("unknown").alias("attribution"), none.alias("shown_as"), F.col("source").alias("source_id"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a source on a path, its format detected; an unknown format is an error."""
    kind, file = detect(spark, path) or ("", "")
    if not kind:
        raise ValueError(f"no known chat format: {path}")
    whole = spark.read.text(file, wholetext=True)
    if kind == "export":
        return parse_export(whole)
    if kind == "capture":
        return parse_capture(whole.select(F.posexplode(F.from_json(_rows(), "array<string>")).alias("pos", "value")))
    lines = whole.select(F.lit(file.rsplit("/", 1)[-1]).alias("source"), F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line_no", "value"))
    return parse_paste(lines)

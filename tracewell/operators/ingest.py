"""Taking in messages: keys, incremental de-duplication, daily roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import collapse, truthy

#: Texts below so many characters are no evidence that two messages are one.
CONTENT_CHARS = 12
#: From the strongest authorship to the weakest.
ATTRIBUTION = ("reliable", "forwarder-shown", "unknown")
#: Zone and source of a file by its kind.
ZONES = {"voice": "raw/voice", "photo": "raw/screenshots", "document": "raw/attachments"}
SOURCES = {"voice": "voice", "photo": "screenshot", "document": "other"}


def minute_of(date: Column) -> Column:
    return F.substring(date, 1, 16)


def primary_key(source_id: Column, msg_id: Column, *content: Column) -> Column:
    """``source:number`` where the source numbers its messages, else a fingerprint of the contents."""
    whole = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in content))
    hashed = F.concat(F.coalesce(F.nullif(source_id, F.lit("")), F.lit("txt")), F.lit(":"), F.left(F.sha2(whole, 256), F.lit(16)))
    return F.when(truthy(msg_id), F.concat(F.coalesce(F.nullif(source_id, F.lit("")), F.lit("src")), F.lit(":"), msg_id)).otherwise(hashed)


def content_key(date: Column, text: Column, media: Column) -> Column:
    """Fingerprint of minute and text, whoever wrote it; null with a file or a short text."""
    clean = collapse(F.coalesce(text, F.lit("")))
    whole = F.concat(minute_of(F.coalesce(date, F.lit(""))), F.lit("|"), clean)
    return F.when(~truthy(media) & (F.length(clean) >= CONTENT_CHARS), F.concat(F.lit("txt:"), F.left(F.sha2(whole, 256), F.lit(16))))


def with_keys(messages: DataFrame) -> DataFrame:
    """``messages`` with ``key`` and ``ckey``."""
    c = F.col
    return messages.withColumn("key", primary_key(c("source_id"), c("msg_id"), c("date"), c("author"), c("text"), c("media"))).withColumn(
        "ckey", content_key(c("date"), c("text"), c("media"))
    )


def known_keys(messages: DataFrame) -> DataFrame:
    """The distinct keys of both kinds."""
    keyed = with_keys(messages)
    return keyed.select(F.explode(F.array_compact(F.array("key", "ckey"))).alias("key")).distinct()


def new_messages(incoming: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Rows of ``incoming`` that neither key of ``known`` (key) has, the first of each primary key by ``order``.

    Two anti-joins, one after the other, and only then the choice inside the batch: a row that is known does not stand
    in the way of a later one. Which row stays is settled by a combining minimum, never in one task per key.
    """
    keyed = with_keys(incoming)
    one = known.select(F.col("key").alias("__tw_k"))
    fresh = keyed.join(one, F.col("key") == F.col("__tw_k"), "left_anti").join(one, F.col("ckey") == F.col("__tw_k"), "left_anti")
    first = fresh.groupBy("key").agg(F.min(order).alias("__tw_first")).select("__tw_first")
    return fresh.join(first, F.col(order) == F.col("__tw_first"), "left_semi")


def rank_of(attribution: Column) -> Column:
    """0 for the strongest authorship; null counts as reliable, anything else as unknown."""
    value = F.coalesce(attribution, F.lit(ATTRIBUTION[0]))
    out = F.lit(len(ATTRIBUTION) - 1)
    for i, a in reversed(list(enumerate(ATTRIBUTION))):
        out = F.when(value == a, F.lit(i)).otherwise(out)
    return out


def level_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ATTRIBUTION)), rank + 1)


def days(messages: DataFrame) -> DataFrame:
    """One row per chat and day: messages, weakest authorship, whether it is mixed, participants (sorted, joined).

    Messages have their ``day`` (see :func:`tracewell.operators.timestamps.message_days`); those without one make a row
    of their own with a null day. Authors are made distinct before they are gathered, so a day is never collected with
    all its messages.
    """
    rows = messages.withColumn("_rank", rank_of(F.col("attribution")))
    facts = rows.groupBy("chat_slug", "day").agg(F.count("*").alias("messages"), F.max("_rank").alias("_weak"), F.min("_rank").alias("_strong"))
    authors = rows.where("author is not null").select("chat_slug", "day", "author").distinct()
    authors = authors.groupBy(F.col("chat_slug").alias("_c"), F.col("day").alias("_d")).agg(F.array_join(F.sort_array(F.collect_list("author")), "; ").alias("participants"))
    joined = facts.join(authors, F.col("chat_slug").eqNullSafe(F.col("_c")) & F.col("day").eqNullSafe(F.col("_d")), "left")
    return joined.select("chat_slug", "day", "messages", level_of(F.col("_weak")).alias("attribution"), (F.col("_weak") != F.col("_strong")).alias("mixed"), F.coalesce("participants", F.lit("")).alias("participants"))


def segments(days_new: DataFrame, days_old: DataFrame, imported: Column) -> DataFrame:
    """(chat_slug, day, file): where new days (chat_slug, day) are written; a day that is there already is not merged.

    Late messages of such a day get a file of their own, named after the day of the import.
    """
    old = days_old.select(F.col("chat_slug").alias("__tw_c"), F.col("day").alias("__tw_d")).distinct()
    joined = days_new.distinct().join(old, F.col("chat_slug").eqNullSafe(F.col("__tw_c")) & (F.col("day") == F.col("__tw_d")), "left")
    late = F.when(F.col("__tw_d").isNotNull(), F.concat(F.lit("_chat-"), imported)).otherwise(F.lit(""))
    return joined.select("chat_slug", "day", F.concat("day", F.lit("_"), "chat_slug", late, F.lit(".md")).alias("file"))


def media_links(messages: DataFrame, files: DataFrame) -> DataFrame:
    """(row_id, media, path): the file each row's attachment is kept in (files: media, path); null where it did not come."""
    rows = messages.where(truthy(F.col("media"))).select("row_id", "media")
    kept = files.groupBy(F.col("media").alias("__tw_m")).agg(F.min("path").alias("path"))
    return rows.join(kept, F.col("media") == F.col("__tw_m"), "left").select("row_id", "media", "path")


def demotions(messages: DataFrame, most: int = 5) -> DataFrame:
    """(chat_slug, day, authors): of days with doubtful authorship, the first authors concerned, sorted; null is undated."""
    rows = messages.where((rank_of(F.col("attribution")) > 0) & F.col("author").isNotNull())
    authors = rows.select("chat_slug", "day", "author").distinct()
    ranked = authors.withColumn("_n", F.row_number().over(Window.partitionBy("chat_slug", "day").orderBy("author"))).where(F.col("_n") <= most)
    return ranked.groupBy("chat_slug", "day").agg(F.array_join(F.sort_array(F.collect_list("author")), "; ").alias("authors"))


def authors(messages: DataFrame) -> DataFrame:
    """(author, messages, first): messages per author and the first row."""
    return messages.where("author is not null").groupBy("author").agg(F.count("*").alias("messages"), F.min("row_id").alias("first"))


#: Messages of a transcript in one part.
PART_MESSAGES = 500
#: What stands before the link to a file, by its kind.
MEDIA_MARKS = {"voice": "🎤 voice", "photo": "🖼 picture"}


def transcript(messages: DataFrame, stored: DataFrame, titles: DataFrame) -> DataFrame:
    """(chat_slug, day, part, messages, text): markdown of a chat's day, in parts of at most ``PART_MESSAGES`` by order.

    Messages have ``day`` and ``clock``; stored (media, path) are files that came, titles (chat_slug, title) the chats'
    titles. The first part begins with title, day and the weakest authorship. Each message has its minute, author (a
    mark where doubtful, the name that was shown, who passed it on), whom it answers, its text, its file and its note. A
    parent's text is repeated only where the parent is not on the same day. Undated messages make a page of their own.
    """
    from tracewell.functions.keys import message_number
    from tracewell.functions.text import escape_markdown
    from tracewell.operators.ranking import positions
    from tracewell.operators.render import reply_lines

    keep = ("chat_slug", "day", "clock", "row_id", "author", "text", "via", "media", "media_kind", "attribution", "shown_as", "note", "reply_context")
    rows = messages.select(*keep, message_number(F.col("msg_id")).alias("_no"), reply_context(F.col("reply_context")).alias("_r"))
    rows = rows.withColumn("_up", message_number(F.col("_r.message_id")))
    there = rows.where("_no is not null").select(F.col("chat_slug").alias("_c"), F.col("day").alias("_d"), F.col("_no").alias("_u"), F.lit(True).alias("_here")).distinct()
    rows = rows.join(there, F.col("chat_slug").eqNullSafe(F.col("_c")) & F.col("day").eqNullSafe(F.col("_d")) & (F.col("_up") == F.col("_u")), "left")
    files = stored.groupBy(F.col("media").alias("_m")).agg(F.min("path").alias("_path"))
    rows = rows.join(files, F.col("media") == F.col("_m"), "left")
    when = lambda c, *x: F.when(c, F.concat(*x)).otherwise(F.lit(""))
    lit = F.lit
    doubt = rank_of(F.col("attribution")) > 0
    head = F.concat(
        lit("### "), F.coalesce("clock", lit("??:??")), lit(" · "), when(doubt, lit("⚠ ")), F.coalesce("author", lit("—")),
        when(truthy(F.col("shown_as")), lit(" _(shown as: "), F.col("shown_as"), lit(")_")), when(truthy(F.col("via")), lit(" _(passed on by: "), F.col("via"), lit(")_")),
    )
    who = reply_authorship(F.col("_r.kind"), F.col("_r.origin_type"), F.col("_r.origin_name"), F.col("_r.author_name"))
    reply = F.when(F.col("_r").isNull(), lit("")).otherwise(F.concat(lit("\n"), reply_lines(who["name"], who["confirmed"], F.col("_r.quote.text"), F.col("_r.text"), F.col("_up").cast("string"), F.col("_here"))))
    mark = F.coalesce(F.element_at(F.create_map(*(lit(x) for p in MEDIA_MARKS.items() for x in p)), F.coalesce("media_kind", lit(""))), lit("📎 file"))
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    file = when(truthy(F.col("media")), lit("\n\n"), mark, lit(": "), F.coalesce(F.concat(lit("[`"), name("_path"), lit("`](../../"), F.col("_path"), lit(")")), F.concat(lit("`"), name("media"), lit("` — no such file"))))
    line = F.concat(head, reply, when(truthy(F.col("text")), lit("\n\n"), escape_markdown(F.col("text"))), file, when(truthy(F.col("note")), lit("\n\n_"), F.col("note"), lit("_")))
    lines = rows.select("chat_slug", "day", F.coalesce("clock", lit("")).alias("clock"), "row_id", "attribution", line.alias("_line"))
    numbered = positions(lines, ["chat_slug", "day"], ["clock", "row_id"], "n").withColumn("part", F.floor((F.col("n") - 1) / PART_MESSAGES))
    joined = numbered.groupBy("chat_slug", "day", "part").agg(F.array_sort(F.collect_list(F.struct("n", "_line"))).alias("_l"))
    facts = messages.groupBy(F.col("chat_slug").alias("_c"), F.col("day").alias("_d")).agg(F.max(rank_of(F.col("attribution"))).alias("_weak"), F.min(rank_of(F.col("attribution"))).alias("_strong"))
    named = titles.groupBy(F.col("chat_slug").alias("_t")).agg(F.min("title").alias("title"))
    pages = joined.join(facts, F.col("chat_slug").eqNullSafe(F.col("_c")) & F.col("day").eqNullSafe(F.col("_d"))).join(named, F.col("chat_slug") == F.col("_t"), "left")
    warning = when(F.col("_weak") > 0, lit("\n\n> ⚠ marks messages whose author is not sure."), F.when(F.col("_weak") != F.col("_strong"), lit(" The others are.")).otherwise(lit(" No message of this day is.")))
    top = F.concat(lit("# "), F.coalesce("title", "chat_slug", lit("—")), lit(" — "), F.coalesce("day", lit("undated")), lit("\n\n> Authorship: "), level_of(F.col("_weak")), warning, lit("\n\n---\n\n"))
    body = F.array_join(F.transform("_l", lambda x: x["_line"]), "\n\n")
    return pages.select("chat_slug", "day", "part", F.size("_l").alias("messages"), F.concat(F.when(F.col("part") == 0, top).otherwise(lit("")), body).alias("text"))


def forward_authorship(origin_type: Column, origin_name: Column, sender: Column) -> Column:
    """(author, via, attribution, shown_as) of a row that may be forwarded.

    Without an origin the sender wrote it. A known user is the author and the sender passed it on. Any other origin
    leaves the author unknown: the shown name is no evidence.
    """
    field = lambda a, v, t, s: F.struct(a.alias("author"), v.alias("via"), F.lit(t).alias("attribution"), s.alias("shown_as"))
    none = F.lit(None).cast("string")
    return (
        F.when(~truthy(origin_type), field(sender, none, "reliable", none))
        .when((origin_type == "user") & truthy(origin_name), field(origin_name, sender, "reliable", none))
        .otherwise(field(none, sender, "forwarder-shown", origin_name))
    )


def reply_authorship(kind: Column, origin_type: Column, origin_name: Column, author_name: Column) -> Column:
    """(name, confirmed) of the parent of a reply."""
    field = lambda n, c: F.struct(n.alias("name"), c.alias("confirmed"))
    none, name, yes, no = F.lit(None).cast("string"), F.nullif(origin_name, F.lit("")), F.lit(True), F.lit(False)
    user = origin_type == "user"
    message = F.when(truthy(origin_type), F.when(user & name.isNotNull(), field(name, yes)).otherwise(field(name, no))).otherwise(
        field(F.nullif(author_name, F.lit("")), truthy(author_name))
    )
    external = F.when(user & name.isNotNull(), field(name, yes)).otherwise(field(name, no))
    return F.when(kind == "message", message).when(kind == "external", external).otherwise(field(none, no))


REPLY = "kind string, message_id string, date string, author_name string, text string, origin_type string, origin_name string, quote struct<text:string>"


def reply_context(text: Column) -> Column:
    """The context of a reply as fields; null if it is no object or empty."""
    clean = F.trim(text)
    ok = F.regexp_like(clean, F.lit(r"(?s)^\{.*\S.*\}$"))
    return F.when(ok, F.from_json(clean, REPLY))


def media_first(messages: DataFrame) -> DataFrame:
    """(media, row_id, kind, zone, source): the first message that refers to each file."""
    rows = messages.where(truthy(F.col("media")))
    first = rows.groupBy("media").agg(F.min(F.struct("row_id", "media_kind")).alias("_f"))
    lookup = lambda names, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col("_f.media_kind")), F.lit(other))
    return first.select("media", "_f.row_id", F.col("_f.media_kind").alias("kind"), lookup(ZONES, "raw/attachments").alias("zone"), lookup(SOURCES, "other").alias("source"))


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, row_id, name): a name of its own for each wanted (path, row_id); taken(path) are not given again.

    The first row keeps the path if it is free; the others get -2, -3, ... before the suffix. Numbers that are taken
    are skipped.
    """
    from tracewell.operators.ranking import positions

    numbered = positions(wanted.select("path", "row_id").distinct(), ["path"], ["row_id"], "n")
    stem, suffix = F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 2)
    number = F.regexp_extract("path", r"^.*?(?:-([0-9]{1,9}))?(\.[^./]*)?$", 1)
    base = F.concat(F.regexp_extract("path", r"^(.*?)(?:-[0-9]{1,9})?(\.[^./]*)?$", 1), F.regexp_extract("path", r"^(.*?)(?:-[0-9]{1,9})?(\.[^./]*)?$", 2))
    whole = taken.select("path", F.lit(1).cast("long").alias("at"))
    numbered_names = taken.where(number != "").select(base.alias("path"), number.cast("long").alias("at")).where("at >= 2")
    used = whole.unionByName(numbered_names).distinct().groupBy("path").agg(F.sort_array(F.collect_list("at")).alias("_used"))
    joined = numbered.join(used.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left")
    shifted = F.aggregate(F.coalesce("_used", F.array().cast("array<bigint>")), F.col("n").cast("long"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    return joined.withColumn("_at", shifted).select(
        "path", "row_id", F.when(F.col("_at") == 1, F.col("path")).otherwise(F.concat(stem, F.lit("-"), F.col("_at").cast("string"), suffix)).alias("name")
    )

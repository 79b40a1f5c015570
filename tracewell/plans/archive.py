"""Queries of the archive's own operators over whole tables, each beside the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.keys import day, record_id
from tracewell.operators import archive, hierarchy, ingest, lint, registry
from tracewell.operators.timestamps import message_days
from tracewell.plans.corpus import INSTANTS
from tracewell.sources import chats, files
from tracewell.session import table

#: The day on which reports that depend on one are made.
AS_OF = "2025-07-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

S = r"[\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]"


class Sql(str):
    """An expression with ``{0}`` for its argument; other braces stand for themselves."""

    def format(self, x: str) -> str:  # type: ignore[override]
        return self.replace("{0}", x)


_TRIM = Sql(f"regexp_replace({{0}}, '^{S}+|{S}+$', '', 'g')")
_COLLAPSE = Sql(f"trim(regexp_replace({{0}}, '{S}+', ' ', 'g'))")
_ID = Sql("nullif(lower(" + _TRIM + "), '')")
_DAY = Sql("CASE WHEN regexp_matches(" + _TRIM + ", '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN TRY_CAST(" + _TRIM + " AS DATE) END")
_BLANK = Sql("coalesce(" + _TRIM + " = '', true)")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can say it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- keys and intake ---------------------------------------------------------------------------------------------
_KEYED = f"""
SELECT *, CASE WHEN coalesce(msg_id, '') <> '' THEN coalesce(nullif(source_id, ''), 'src') || ':' || msg_id
  ELSE coalesce(nullif(source_id, ''), 'txt') || ':' || left(sha256(coalesce(date, '') || '|' || coalesce(author, '') || '|' || coalesce(text, '') || '|' || coalesce(media, '')), 16) END AS key,
  CASE WHEN coalesce(media, '') = '' AND length({_COLLAPSE.format("coalesce(text, '')")}) >= 12
  THEN 'txt:' || left(sha256(left(coalesce(date, ''), 16) || '|' || {_COLLAPSE.format("coalesce(text, '')")}), 16) END AS ckey FROM messages"""


@query(f"SELECT row_id, key, ckey FROM ({_KEYED})")
def message_keys(spark: SparkSession, d: str) -> DataFrame:
    """Primary and content key of every row."""
    return ingest.with_keys(table(spark, d, "messages")).select("row_id", "key", "ckey")


@query(f"SELECT DISTINCT unnest([key, ckey]) AS key FROM ({_KEYED}) QUALIFY key IS NOT NULL".replace(" QUALIFY key IS NOT NULL", ""))
def import_keys(spark: SparkSession, d: str) -> DataFrame:
    """All keys of both kinds, once."""
    return ingest.known_keys(table(spark, d, "messages"))


ORACLE["import_keys"] = f"SELECT DISTINCT key FROM (SELECT unnest([key, ckey]) AS key FROM ({_KEYED})) WHERE key IS NOT NULL"


@query(f"SELECT ckey, count(*) AS n FROM ({_KEYED}) WHERE ckey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Contents that were said more than once in a minute."""
    keyed = ingest.with_keys(table(spark, d, "messages")).where("ckey is not null")
    return keyed.groupBy("ckey").agg(F.count("*").alias("n")).where("n > 1")


@query(
    f"""WITH k AS ({_KEYED}), known AS (SELECT key FROM k WHERE batch_id % 2 = 0 UNION SELECT ckey FROM k WHERE batch_id % 2 = 0),
fresh AS (SELECT * FROM k WHERE batch_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM known n WHERE n.key = k.key) AND NOT EXISTS (SELECT 1 FROM known n WHERE n.key = k.ckey))
SELECT min(row_id) AS row_id FROM fresh GROUP BY key"""
)
def incremental_import(spark: SparkSession, d: str) -> DataFrame:
    """What the odd batches add to the even ones: two sources that are taken in one after the other."""
    rows = table(spark, d, "messages")
    known = ingest.known_keys(rows.where("batch_id % 2 = 0"))
    return ingest.new_messages(rows.where("batch_id % 2 = 1"), known, "row_id").select("row_id")


_RANK = "CASE coalesce(attribution, 'reliable') WHEN 'reliable' THEN 0 WHEN 'forwarder-shown' THEN 1 ELSE 2 END"
_DATED = f"SELECT m.*, strftime(i.local, '%Y-%m-%d') AS day, strftime(i.local, '%H:%M') AS clock, {_RANK} AS r FROM messages m JOIN ({INSTANTS}) i USING (row_id)"


def _days(spark: SparkSession, d: str) -> DataFrame:
    """Messages with day and minute of the chat's clock; null where the date denotes no instant."""
    return message_days(table(spark, d, "messages"), table(spark, d, "chats"))




@query(
    f"""SELECT chat_slug, day, count(*) AS messages, ['reliable', 'forwarder-shown', 'unknown'][max(r) + 1] AS attribution, max(r) <> min(r) AS mixed,
coalesce(string_agg(DISTINCT author, '; ' ORDER BY author), '') AS participants FROM ({_DATED}) GROUP BY 1, 2"""
)
def day_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Messages, weakest authorship and participants of each chat's days."""
    return ingest.days(_days(spark, d))


@query(
    f"""SELECT chat_slug, day, string_agg(author, '; ' ORDER BY author) AS authors FROM (
SELECT DISTINCT chat_slug, day, author, dense_rank() OVER (PARTITION BY chat_slug, day ORDER BY author) AS n FROM ({_DATED}) WHERE r > 0 AND author IS NOT NULL) WHERE n <= 5 GROUP BY 1, 2"""
)
def day_demotions(spark: SparkSession, d: str) -> DataFrame:
    """First authors of doubtful rows per day."""
    return ingest.demotions(_days(spark, d))


@query("SELECT author, count(*) AS messages, min(row_id) AS first FROM messages WHERE author IS NOT NULL GROUP BY 1 ORDER BY messages DESC, first LIMIT 20")
def authors_top(spark: SparkSession, d: str) -> DataFrame:
    """The twenty busiest authors, the earlier one first where they are equal."""
    return ingest.authors(table(spark, d, "messages")).orderBy(F.desc("messages"), "first").limit(20)


@query(
    f"""SELECT count(*) AS messages, count(*) FILTER (media_kind = 'voice') AS voice, count(*) FILTER (media_kind = 'photo') AS photo, count(*) FILTER (media_kind = 'document') AS document,
count(*) FILTER (via IS NOT NULL) AS forwarded, count(*) FILTER (day IS NULL) AS undated, min(day) AS first_day, max(day) AS last_day FROM ({_DATED})"""
)
def import_plan(spark: SparkSession, d: str) -> DataFrame:
    """What an import would bring: kinds, forwarded and undated rows, first and last day."""
    rows = _days(spark, d)
    kind = lambda k: F.count_if(F.col("media_kind") == k).alias(k)
    return rows.agg(
        F.count("*").alias("messages"), kind("voice"), kind("photo"), kind("document"), F.count_if(F.col("via").isNotNull()).alias("forwarded"),
        F.count_if(F.col("day").isNull()).alias("undated"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


@query("SELECT parser, count(*) AS batches, sum(messages)::BIGINT AS delivered, count(*) FILTER (messages = 0) AS empty, count(*) FILTER (source IS NULL) AS sourceless FROM import_batches GROUP BY 1")
def import_stats(spark: SparkSession, d: str) -> DataFrame:
    """Batches per parser."""
    b = table(spark, d, "import_batches")
    return b.groupBy("parser").agg(F.count("*").alias("batches"), F.sum("messages").alias("delivered"), F.count_if(F.col("messages") == 0).alias("empty"), F.count_if(F.col("source").isNull()).alias("sourceless"))


_FIRST = """SELECT media, min(row_id) AS row_id FROM messages WHERE coalesce(media, '') <> '' GROUP BY 1"""


@query(
    f"""SELECT f.media, f.row_id, m.media_kind AS kind, CASE m.media_kind WHEN 'voice' THEN 'raw/voice' WHEN 'photo' THEN 'raw/screenshots' ELSE 'raw/attachments' END AS zone,
CASE m.media_kind WHEN 'voice' THEN 'voice' WHEN 'photo' THEN 'screenshot' ELSE 'other' END AS source FROM ({_FIRST}) f JOIN messages m USING (row_id)"""
)
def media_first(spark: SparkSession, d: str) -> DataFrame:
    """The row that files each attachment, its zone and source."""
    return ingest.media_first(table(spark, d, "messages"))


@query(
    """WITH w AS (SELECT media AS path, row_id, row_number() OVER (PARTITION BY media ORDER BY row_id) AS n FROM (SELECT DISTINCT media, row_id FROM messages WHERE media <> '')),
t AS (SELECT DISTINCT raw_path AS path FROM items WHERE raw_path IS NOT NULL),
u AS (SELECT path, 1::BIGINT AS k FROM t UNION SELECT regexp_replace(path, '-[0-9]{1,9}([.][^./]*)?$', '\\1'), regexp_extract(path, '-([0-9]{1,9})(?:[.][^./]*)?$', 1)::BIGINT FROM t WHERE regexp_matches(path, '-[0-9]{1,9}([.][^./]*)?$')),
m AS (SELECT w.path, max(n) + coalesce(max(x.c), 0) AS most FROM w LEFT JOIN (SELECT path, count(*) AS c FROM u GROUP BY 1) x USING (path) GROUP BY 1),
c AS (SELECT path, unnest(range(1, most + 1)) AS k FROM m),
f AS (SELECT path, k, row_number() OVER (PARTITION BY path ORDER BY k) AS n FROM c ANTI JOIN u USING (path, k))
SELECT w.path, w.row_id, CASE WHEN f.k = 1 THEN w.path ELSE regexp_replace(w.path, '^(.*?)([.][^./]*)?$', '\\1-' || f.k || '\\2') END AS name FROM w JOIN f USING (path, n)"""
)
def media_names(spark: SparkSession, d: str) -> DataFrame:
    """A name of its own for the attachment of every row that has one, beside the paths items already use."""
    rows = table(spark, d, "messages").where("media <> ''").select(F.col("media").alias("path"), "row_id")
    return ingest.free_names(rows, table(spark, d, "items").where("raw_path is not null").select(F.col("raw_path").alias("path")))


@query(
    f"""WITH f AS ({_FIRST}), top AS (SELECT max(TRY_CAST(substr(id, 2) AS BIGINT)) AS m FROM (SELECT id FROM items UNION ALL SELECT id FROM retired) WHERE regexp_matches(id, '^i[0-9]+$'))
SELECT media, 'i' || lpad((m + row_number() OVER (ORDER BY row_id))::VARCHAR, 9, '0') AS item_id FROM f, top"""
)
def media_ids(spark: SparkSession, d: str) -> DataFrame:
    """New item ids for attachments, in the order of the rows that file them, after all ids ever used."""
    from tracewell.operators.ranking import positions

    ids = table(spark, d, "items").select("id").unionByName(table(spark, d, "retired").select("id"))
    last = ids.where(F.regexp_like("id", F.lit("^i[0-9]+$"))).agg(F.max(F.substring("id", 2, 18).cast("long")).alias("_m"), F.lit(1).alias("_all"))
    first = ingest.media_first(table(spark, d, "messages")).select("media", "row_id", F.lit(1).alias("_all"))
    numbered = positions(first, ["_all"], ["row_id"], "n").join(F.broadcast(last), "_all")  # one row
    return numbered.select("media", F.concat(F.lit("i"), F.lpad((F.col("_m") + F.col("n")).cast("string"), 9, "0")).alias("item_id"))


@query(
    """SELECT prefix, prefix || CASE WHEN length((max(n) + 1)::VARCHAR) < 3 THEN lpad((max(n) + 1)::VARCHAR, 3, '0') ELSE (max(n) + 1)::VARCHAR END AS next FROM (
SELECT left(id, 1) AS prefix, substr(id, 2)::BIGINT AS n FROM (SELECT lower(trim(id)) AS id FROM items UNION ALL SELECT lower(trim(id)) FROM requirements UNION ALL SELECT lower(trim(id)) FROM people UNION ALL SELECT lower(trim(id)) FROM retired)
WHERE regexp_matches(id, '^[a-z][0-9]{1,18}$')) GROUP BY 1"""
)
def next_ids(spark: SparkSession, d: str) -> DataFrame:
    """The next free id of each kind."""
    live = table(spark, d, "items").select("id").unionByName(table(spark, d, "requirements").select("id")).unionByName(table(spark, d, "people").select("id"))
    return archive.next_ids(live, table(spark, d, "retired"))


@query()
def day_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of each chat's days, with links to the item files that are named like the attachments."""
    items = table(spark, d, "items").where("raw_path is not null and status = 'present'").select(F.regexp_extract("raw_path", "([^/]+)$", 1).alias("media"), F.col("raw_path").alias("path"))
    return ingest.transcript(_days(spark, d), items, table(spark, d, "chats"))


@query(f"SELECT day, chat_slug, count(*) AS messages, count(*) FILTER (clock < '12:00') AS before_noon FROM ({_DATED}) GROUP BY ALL")
def day_clock(spark: SparkSession, d: str) -> DataFrame:
    """Messages of each chat and day by the chat's own clock, before noon and in all; undated ones as a day of their own."""
    return _days(spark, d).groupBy("day", "chat_slug").agg(F.count("*").alias("messages"), F.count_if(F.col("clock") < "12:00").alias("before_noon"))


# --- authorship --------------------------------------------------------------------------------------------------
@query(
    """WITH o AS (SELECT row_id, author, shown_as, via, CASE WHEN via IS NOT NULL THEN 'user' WHEN shown_as IS NOT NULL THEN 'hidden_user' END AS t, CASE WHEN via IS NOT NULL THEN via ELSE shown_as END AS n FROM messages)
SELECT row_id, CASE WHEN t IS NULL THEN author WHEN t = 'user' AND coalesce(n, '') <> '' THEN n END AS author, CASE WHEN t IS NOT NULL THEN author END AS via,
CASE WHEN t IS NULL OR (t = 'user' AND coalesce(n, '') <> '') THEN 'reliable' ELSE 'forwarder-shown' END AS attribution, CASE WHEN t IS NOT NULL AND NOT (t = 'user' AND coalesce(n, '') <> '') THEN n END AS shown_as FROM o"""
)
def forward_authorship(spark: SparkSession, d: str) -> DataFrame:
    """Who wrote a row that was passed on, and how sure that is."""
    rows = table(spark, d, "messages").select("row_id", "author", "shown_as", "via")
    kind = F.when(F.col("via").isNotNull(), "user").when(F.col("shown_as").isNotNull(), "hidden_user")
    return rows.select("row_id", ingest.forward_authorship(kind, F.coalesce("via", "shown_as"), F.col("author")).alias("w")).select("row_id", "w.*")


_REPLY = """SELECT row_id, json_extract_string(reply_context, '$.kind') AS kind, json_extract_string(reply_context, '$.message_id') AS message_id, json_extract_string(reply_context, '$.origin_type') AS t,
nullif(json_extract_string(reply_context, '$.origin_name'), '') AS n, nullif(json_extract_string(reply_context, '$.author_name'), '') AS a FROM messages WHERE reply_context IS NOT NULL"""


@query(
    f"""SELECT row_id, kind, CASE kind WHEN 'message' THEN CASE WHEN coalesce(t, '') <> '' THEN n ELSE a END WHEN 'external' THEN n END AS name,
CASE kind WHEN 'message' THEN CASE WHEN coalesce(t, '') <> '' THEN t = 'user' AND n IS NOT NULL ELSE a IS NOT NULL END WHEN 'external' THEN coalesce(t = 'user', false) AND n IS NOT NULL ELSE false END AS confirmed FROM ({_REPLY})"""
)
def reply_authorship(spark: SparkSession, d: str) -> DataFrame:
    """Who wrote what a row replies to, and whether that is confirmed."""
    rows = table(spark, d, "messages").where("reply_context is not null").select("row_id", ingest.reply_context(F.col("reply_context")).alias("c"))
    who = ingest.reply_authorship(F.col("c.kind"), F.col("c.origin_type"), F.col("c.origin_name"), F.col("c.author_name"))
    return rows.select("row_id", "c.kind", who.alias("w")).select("row_id", "kind", "w.*")


_NUMBER = Sql(r"TRY_CAST(regexp_extract({0}, '^\s*(?:[^:]*:)?\s*0*([0-9]{1,19})(?:\.0*)?\s*$', 1) AS BIGINT)")


@query(
    f"""WITH m AS (SELECT row_id, chat_slug, day, {_NUMBER.format("msg_id")} AS no, {_NUMBER.format("reply_to")} AS up FROM ({_DATED}))
SELECT row_id, EXISTS (SELECT 1 FROM m p WHERE p.chat_slug = m.chat_slug AND p.day = m.day AND p.no = m.up) AS present FROM m WHERE up IS NOT NULL"""
)
def reply_parent_present(spark: SparkSession, d: str) -> DataFrame:
    """Whether the message that a row replies to is in the same chat and day."""
    from tracewell.functions.keys import message_number

    rows = _days(spark, d).select("row_id", "chat_slug", "day", message_number(F.col("msg_id")).alias("no"), message_number(F.col("reply_to")).alias("up"))
    there = rows.where("no is not null").select("chat_slug", "day", F.col("no").alias("up"), F.lit(True).alias("_p")).distinct()
    return rows.where("up is not null").join(there, ["chat_slug", "day", "up"], "left").select("row_id", F.coalesce("_p", F.lit(False)).alias("present"))


# --- people ------------------------------------------------------------------------------------------------------
_NAME_KEY = Sql("trim(regexp_replace(regexp_replace(lower(" + _TRIM + r"), '[^\p{L}\p{N}_@.\- \t\n\x0b\f\r]', '', 'g'), '" + S + "+', ' ', 'g'))")
_CANDIDATES = f"""SELECT id, {_NAME_KEY.format("name")} AS key FROM (SELECT id, unnest(list_concat([display, id], coalesce(aliases, []), coalesce(map_values(handles), []))) AS name FROM people) WHERE name IS NOT NULL"""


@query(f"SELECT a.author AS name, min(c.id) AS id FROM (SELECT DISTINCT author FROM messages WHERE author IS NOT NULL) a LEFT JOIN (SELECT key, id FROM ({_CANDIDATES}) WHERE key <> '') c ON c.key = {_NAME_KEY.format('a.author')} GROUP BY 1")
def resolve_person(spark: SparkSession, d: str) -> DataFrame:
    """The first person who has an author's name exactly."""
    return registry.resolve(table(spark, d, "messages").select(F.col("author").alias("name")), table(spark, d, "people"))


_NAMES = "SELECT unnest(participants) AS name FROM items UNION ALL SELECT wanted_by FROM requirements"


@query(f"SELECT DISTINCT n.name FROM ({_NAMES}) n LEFT JOIN (SELECT DISTINCT key FROM ({_CANDIDATES}) WHERE key <> '') c ON c.key = {_NAME_KEY.format('n.name')} WHERE n.name <> '' AND c.key IS NULL")
def strangers(spark: SparkSession, d: str) -> DataFrame:
    """Names in items and requirements that nobody in people has."""
    names = table(spark, d, "items").select(F.explode("participants").alias("name")).unionByName(table(spark, d, "requirements").select(F.col("wanted_by").alias("name")))
    return registry.strangers(names, table(spark, d, "people"))


_ALIAS = f"""SELECT DISTINCT id, lower({_TRIM.format("name")}) AS key FROM (SELECT id, unnest(list_concat([display, id], coalesce(aliases, []))) AS name FROM people) WHERE name IS NOT NULL AND {_TRIM.format("name")} <> ''"""
_ACCOUNT = f"""SELECT DISTINCT id, type, lower({_TRIM.format("name")}) AS account FROM (SELECT id, unnest(map_keys(handles)) AS type, unnest(map_values(handles)) AS name FROM people) WHERE name IS NOT NULL AND {_TRIM.format("name")} <> ''"""


@query(f"SELECT key, count(*) AS people, min(id) AS first FROM ({_ALIAS}) GROUP BY 1 HAVING count(*) > 1")
def alias_clash(spark: SparkSession, d: str) -> DataFrame:
    """Names of several people."""
    return registry.alias_clashes(table(spark, d, "people"))


@query(f"SELECT type, account, count(*) AS people, min(id) AS first FROM ({_ACCOUNT}) GROUP BY 1, 2 HAVING count(*) > 1")
def account_clash(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of several people."""
    return registry.account_clashes(table(spark, d, "people"))


# --- records -----------------------------------------------------------------------------------------------------
@query(f"SELECT {_ID.format('supersedes')} AS id, max({_ID.format('id')}) AS superseded_by FROM requirements WHERE {_ID.format('supersedes')} IS NOT NULL GROUP BY 1")
def superseded_by(spark: SparkSession, d: str) -> DataFrame:
    """What replaces a requirement."""
    return archive.superseded_by(table(spark, d, "requirements")).where("id is not null")


_BLOCKED = f"CASE WHEN coalesce(blocking, '') <> '' THEN DATE '{AS_OF}' - ({_DAY.format('coalesce(nullif(blocking_since, chr(0)), date)')}) END".replace("nullif(blocking_since, chr(0))", "nullif(blocking_since, '')")


@query(
    f"""SELECT id, days_blocked::INT AS days_blocked, row_number() OVER (ORDER BY (coalesce(blocking, '') = ''), -coalesce(days_blocked, 0), coalesce(date, ''), id) AS rank
FROM (SELECT *, {_BLOCKED} AS days_blocked FROM (SELECT DISTINCT id, blocking, blocking_since, date FROM requirements))"""
)
def requirement_order(spark: SparkSession, d: str) -> DataFrame:
    """Requirements in the order of the report."""
    return archive.requirement_order(table(spark, d, "requirements"), AS_OF)


@query(f"SELECT a.id, a.target FROM (SELECT DISTINCT {_ID.format('id')} AS id, {_ID.format('supersedes')} AS target FROM requirements) a WHERE target IS NOT NULL AND target NOT IN (SELECT {_ID.format('id')} FROM requirements)")
def dangling_supersedes(spark: SparkSession, d: str) -> DataFrame:
    """Requirements that replace unknown ones."""
    rows = table(spark, d, "requirements").select(record_id(F.col("id")).alias("id"), record_id(F.col("supersedes")).alias("target"))
    known = rows.select(F.col("id").alias("_k")).distinct()
    return rows.where("target is not null").distinct().join(known, F.col("target") == F.col("_k"), "left_anti")


def _cycles(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.links(table(spark, d, "requirements"), record_id(F.col("id")), record_id(F.col("supersedes")))
    return hierarchy.cycle_names(hierarchy.peel(nodes)[1])


_WALK = f"""WITH RECURSIVE e AS (SELECT {_ID.format("id")} AS id, min({_ID.format("supersedes")}) AS up FROM requirements GROUP BY 1), ok AS (SELECT a.id, a.up FROM e a JOIN e b ON a.up = b.id),
w AS (SELECT id, up AS tip FROM ok UNION SELECT w.id, ok.up FROM w JOIN ok ON ok.id = w.tip)"""


@query(_WALK + ", c AS (SELECT id FROM w WHERE id = tip) SELECT cycle, count(*) AS members FROM (SELECT w.id, min(w.tip) AS cycle FROM w JOIN c ON c.id = w.id GROUP BY 1) GROUP BY 1")
def supersede_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Each cycle of replacements once."""
    return _cycles(spark, d).groupBy("cycle").agg(F.count("*").alias("members"))


@query("SELECT id, date, row_number() OVER (ORDER BY date, id) AS rank FROM (SELECT DISTINCT id, coalesce(date, '') AS date FROM items)")
def index_chronology(spark: SparkSession, d: str) -> DataFrame:
    """Items by date."""
    return archive.chronology(table(spark, d, "items"))


@query("SELECT CASE WHEN raw_path IS NULL THEN '—' WHEN regexp_matches(raw_path, '^raw/[^/]+/') THEN regexp_extract(raw_path, '^(raw/[^/]+)/', 1) ELSE 'raw' END AS zone, count(*) AS items FROM items GROUP BY 1")
def index_zones(spark: SparkSession, d: str) -> DataFrame:
    """Items per zone."""
    return archive.zones(table(spark, d, "items"))


@query("SELECT DISTINCT id, status, raw_path FROM items WHERE status IS DISTINCT FROM 'present'")
def index_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Items that are not there."""
    return archive.gaps(table(spark, d, "items"))


_FIDELITY = "CASE coalesce(fidelity, 'placeholder') WHEN 'verbatim' THEN 1 WHEN 'reconstructed' THEN 2 WHEN 'digest' THEN 3 WHEN 'placeholder' THEN 4 ELSE 5 END"


@query(f"SELECT coalesce(fidelity, 'placeholder') AS level, {_FIDELITY} AS rank, count(*) AS items FROM items GROUP BY 1, 2")
def fidelity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Items per level of fidelity."""
    return archive.histogram(table(spark, d, "items"), "fidelity", lint.FIDELITY, "placeholder")


@query("SELECT redaction, count(*) AS items FROM (SELECT DISTINCT id, unnest(redactions) AS redaction FROM items) GROUP BY 1")
def redaction_uses(spark: SparkSession, d: str) -> DataFrame:
    """Items per redaction."""
    return archive.redaction_uses(table(spark, d, "items"))


@query("SELECT id, CASE WHEN coalesce(len(redactions), 0) > 0 THEN '[redacted]' ELSE quote END AS quote FROM requirements")
def masked_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes as a report shows them."""
    return table(spark, d, "requirements").select("id", archive.visible(F.col("quote"), F.col("redactions")).alias("quote"))


@query("SELECT coalesce(contour, 'work') AS level, CASE coalesce(contour, 'work') WHEN 'work' THEN 1 WHEN 'personal' THEN 2 WHEN 'public' THEN 3 ELSE 4 END AS rank, count(*) AS items FROM items WHERE contour IS DISTINCT FROM 'public' GROUP BY 1, 2")
def held_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Items that are held back, per contour."""
    return archive.histogram(archive.held(table(spark, d, "items")), "contour", lint.CONTOURS, "work")


@query("SELECT id, source, date, raw_path, sha256, 'public' AS contour, len(coalesce(derived_paths, []))::INT AS derived FROM items WHERE contour = 'public'")
def publish_slim(spark: SparkSession, d: str) -> DataFrame:
    """The public slice."""
    return archive.slim(table(spark, d, "items"))


@query(
    """SELECT count(*) FILTER (status = 'present' AND coalesce(raw_path, '') <> '') AS copied, coalesce(sum(CASE WHEN status = 'present' AND coalesce(raw_path, '') <> '' THEN len(coalesce(derived_paths, [])) END), 0)::BIGINT AS derived,
count(*) FILTER (NOT coalesce(status = 'present' AND coalesce(raw_path, '') <> '', false)) AS skipped FROM items WHERE contour = 'public'"""
)
def publish_counts(spark: SparkSession, d: str) -> DataFrame:
    """What publishing copies and skips."""
    return archive.publish_counts(table(spark, d, "items"))


@query(
    f"""SELECT w.id, min(b.bucket) AS bucket FROM (SELECT DISTINCT {_ID.format("x")} AS id FROM (SELECT unnest(based_on) AS x FROM requirements)) w
JOIN (SELECT {_ID.format("id")} AS id, '1 items' AS bucket FROM items UNION ALL SELECT {_ID.format("id")}, '2 requirements' FROM requirements UNION ALL SELECT {_ID.format("id")}, '3 retired' FROM retired) b USING (id) GROUP BY 1"""
)
def record_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Where the records that requirements are based on are found first."""
    wanted = table(spark, d, "requirements").select(F.explode("based_on").alias("id"))
    return archive.lookup([("1 items", table(spark, d, "items")), ("2 requirements", table(spark, d, "requirements")), ("3 retired", table(spark, d, "retired"))], wanted).where("id is not null")


_LISTED = Sql("coalesce(array_to_string(list_filter(list_transform({0}, lambda x: " + _TRIM.format("x") + "), lambda x, i: x <> '' AND list_position(list_transform({0}, lambda y: " + _TRIM.format("y") + "), x) = i), '; '), '')")


@query(f"SELECT id, coalesce(attribution, 'reliable') AS attribution, {_LISTED.format('participants')} AS participants, {_LISTED.format('tags')} AS tags FROM items")
def item_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Items with their defaults."""
    return archive.item_defaults(table(spark, d, "items"))


@query(
    """SELECT list_max([CASE WHEN (SELECT count(*) FROM import_batches) > 0 THEN '1.1' ELSE '1.0' END, CASE WHEN (SELECT count(*) FROM people) > 0 THEN '1.2' ELSE '1.0' END,
CASE WHEN (SELECT count(*) FROM retired) > 0 THEN '1.5' ELSE '1.0' END, CASE WHEN (SELECT count(*) FROM requirements) > 0 THEN '1.7' ELSE '1.0' END]) AS version"""
)
def required_version(spark: SparkSession, d: str) -> DataFrame:
    """The least version of the format that holds these tables."""
    return lint.required_version(_sections(spark, d))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    names = (("imports", "import_batches"), ("people", "people"), ("retired", "retired"), ("requirements", "requirements"))
    return lint.union([table(spark, d, name).agg(F.count("*").alias("rows")).select(F.lit(section).alias("section"), "rows") for section, name in names])


# --- integrity ---------------------------------------------------------------------------------------------------
def _files(spark: SparkSession, d: str) -> DataFrame:
    """Files that messages brought, as a tree of raw files would list them."""
    rows = table(spark, d, "messages").where("media <> ''").select(F.concat(F.lit("raw/"), "media").alias("path")).distinct()
    named = table(spark, d, "items").where("raw_path is not null and status = 'present'").select(F.col("raw_path").alias("path"), "sha256").distinct()
    return rows.select("path", F.sha2("path", 256).alias("sha256")).unionByName(named)


_FILES = "SELECT path, sha256(path) AS sha256 FROM (SELECT DISTINCT 'raw/' || media AS path FROM messages WHERE media <> '') UNION ALL SELECT DISTINCT raw_path, sha256 FROM items WHERE raw_path IS NOT NULL AND status = 'present'"


@query(f"SELECT DISTINCT path FROM ({_FILES}) WHERE path NOT IN (SELECT raw_path FROM items WHERE raw_path IS NOT NULL UNION SELECT unnest(derived_paths) FROM items)")
def untracked_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files that no item names."""
    return lint.untracked(table(spark, d, "items"), _files(spark, d))


def _v(sql: str, severity: str, code: str, message: str, place: str) -> str:
    return f"SELECT '{severity}' AS severity, '{code}' AS code, {message} AS message, {place} AS place {sql}"


_LINT = {
    "v05": _v(f"FROM items WHERE coalesce(fidelity, '') <> 'verbatim' AND {_BLANK.format('fidelity_note')}", "E", "V05", "'fidelity without a note'", "id"),
    "v06": " UNION ALL ".join(
        (
            _v(f"FROM items WHERE status = 'missing' AND {_BLANK.format('raw_path')}", "E", "V06", "'missing without expected path'", "id"),
            _v("FROM items WHERE status = 'unrecoverable' AND raw_path IS NOT NULL", "E", "V06", "'unrecoverable with a path'", "id"),
            _v("FROM items WHERE status = 'unrecoverable' AND fidelity IS DISTINCT FROM 'placeholder'", "E", "V06", "'unrecoverable but no placeholder'", "id"),
        )
    ),
    "v10": " UNION ALL ".join(
        [
            _v("FROM (SELECT id, count(*) - 1 AS extra FROM items GROUP BY 1) WHERE id IS NOT NULL AND extra > 0", "E", "V10", "'id repeated ' || extra", "id"),
            _v(f"FROM items WHERE ({_DAY.format('date')}) IS NULL OR ({_DAY.format('date')}) > DATE '{AS_OF}'", "E", "V10", "'no such day'", "id"),
        ]
        + [
            _v(f"FROM items WHERE NOT coalesce({c} IN ({', '.join(repr(x) for x in dom)}), false)", "E", "V10", f"'{c} outside its domain'", "id")
            for c, dom in (("source", lint.SOURCES), ("fidelity", lint.FIDELITY), ("status", lint.STATUS), ("contour", lint.CONTOURS))
        ]
    ),
    "v13": " UNION ALL ".join(
        (
            _v("FROM items WHERE attribution NOT IN ('reliable', 'forwarder-shown', 'unknown')", "E", "V13", "'attribution outside its domain'", "id"),
            _v(f"FROM items WHERE coalesce(attribution, 'reliable') <> 'reliable' AND {_BLANK.format('fidelity_note')}", "E", "V13", "'doubtful authorship without a note'", "id"),
        )
    ),
    "v16": " UNION ALL ".join(
        (
            _v("FROM (SELECT id FROM people GROUP BY 1 HAVING count(*) > 1) WHERE id IS NOT NULL", "E", "V16", "'id repeated'", "id"),
            _v(f"FROM people WHERE NOT coalesce(role IN ({', '.join(repr(x) for x in lint.ROLES)}), false)", "E", "V16", "'role outside its domain'", "id"),
            _v(f"FROM people WHERE {_BLANK.format('display')}", "E", "V16", "'no display name'", "id"),
            _v("FROM (SELECT count(*) AS n FROM people WHERE role = 'self') WHERE n > 1", "E", "V16", "'more than one self'", "n::VARCHAR"),
            _v(f"FROM (SELECT key FROM ({_ALIAS}) GROUP BY 1 HAVING count(*) > 1)", "E", "V16", "'name of several people'", "key"),
            _v(f"FROM (SELECT type, account FROM ({_ACCOUNT}) GROUP BY 1, 2 HAVING count(*) > 1)", "E", "V16", "'account of several people'", "type || ':' || account"),
        )
    ),
    "v17": _v("FROM (SELECT DISTINCT id, min(id) OVER (PARTITION BY raw_path) AS first FROM items WHERE raw_path <> '') WHERE id <> first", "E", "V17", "'file of ' || first", "id"),
}


@query(_LINT["v05"])
def lint_v05(spark: SparkSession, d: str) -> DataFrame:
    return lint.v05(table(spark, d, "items"))


@query(_LINT["v06"])
def lint_v06(spark: SparkSession, d: str) -> DataFrame:
    return lint.v06(table(spark, d, "items"))


@query("SELECT 'E' AS severity, 'V09' AS code, 'unknown redaction ' || redaction AS message, id AS place FROM (SELECT id, unnest(redactions) AS redaction FROM items) WHERE redaction NOT IN (SELECT reason FROM retired WHERE reason IS NOT NULL)")
def lint_v09(spark: SparkSession, d: str) -> DataFrame:
    """Redactions of items against the reasons that are in use."""
    reasons = table(spark, d, "retired").where("reason is not null").select(F.col("reason").alias("id")).distinct()
    return lint.v09(table(spark, d, "items").select("id", "redactions"), reasons)


@query(_LINT["v10"])
def lint_v10(spark: SparkSession, d: str) -> DataFrame:
    return lint.v10(table(spark, d, "items"), AS_OF)


@query(_LINT["v13"])
def lint_v13(spark: SparkSession, d: str) -> DataFrame:
    return lint.v13(table(spark, d, "items"))


@query(f"SELECT 'W' AS severity, 'V14' AS code, 'nobody in people' AS message, name AS place FROM ({ORACLE['strangers']})")
def lint_v14(spark: SparkSession, d: str) -> DataFrame:
    return lint.v14(table(spark, d, "items"), table(spark, d, "requirements"), table(spark, d, "people"))


@query(_LINT["v16"])
def lint_v16(spark: SparkSession, d: str) -> DataFrame:
    return lint.v16(table(spark, d, "people"))


@query(_LINT["v17"])
def lint_v17(spark: SparkSession, d: str) -> DataFrame:
    return lint.v17(table(spark, d, "items"))


_SHORT = "SELECT DISTINCT id, regexp_replace(raw_path, '[^_]*_[0-9]+[.]', '.') AS raw_path FROM items"


@query("SELECT 'E' AS severity, 'V17' AS code, 'file of ' || first AS message, id AS place FROM (SELECT id, min(id) OVER (PARTITION BY raw_path) AS first FROM (" + _SHORT + ") WHERE raw_path <> '') WHERE id <> first")
def lint_v17_shared(spark: SparkSession, d: str) -> DataFrame:
    """Items whose files lose what tells them apart: one file a zone and day."""
    items = table(spark, d, "items").select("id", F.regexp_replace("raw_path", "[^_]*_[0-9]+[.]", ".").alias("raw_path"))
    return lint.v17(items)


#: What a listing of an archive's files would show: of the items' files some are lost, some are not what they were, some
#: missing ones have come; and what messages brought.
_DISK = """SELECT raw_path AS path, min(CASE WHEN left(sha256, 1) = 'e' THEN sha256(raw_path) ELSE sha256 END) AS sha256 FROM items WHERE raw_path IS NOT NULL AND coalesce(left(sha256, 1), '0') <> 'f' AND (status = 'present' OR id LIKE '%7') GROUP BY 1
UNION ALL SELECT 'raw/' || media, sha256(media) FROM (SELECT DISTINCT media FROM messages WHERE media <> '') UNION ALL SELECT path, NULL FROM (VALUES ('INDEX.md'), ('.git/config'), ('notes/a.md')) t(path)"""


def _disk(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "items").where("raw_path is not null and coalesce(left(sha256, 1), '0') <> 'f' and (status = 'present' or id like '%7')")
    kept = there.groupBy(F.col("raw_path").alias("path")).agg(F.min(F.when(F.left("sha256", F.lit(1)) == "e", F.sha2("raw_path", 256)).otherwise(F.col("sha256"))).alias("sha256"))
    brought = table(spark, d, "messages").where("media <> ''").select("media").distinct().select(F.concat(F.lit("raw/"), "media").alias("path"), F.sha2("media", 256).alias("sha256"))
    return kept.unionByName(brought).unionByName(spark.createDataFrame([("INDEX.md", None), (".git/config", None), ("notes/a.md", None)], "path string, sha256 string"))


@query(
    f"""WITH f AS ({_DISK}) SELECT 'E' AS severity, CASE WHEN f.path IS NULL THEN 'V01' ELSE 'V02' END AS code, CASE WHEN f.path IS NULL THEN 'no file' ELSE 'other contents' END AS message, id AS place
FROM items i LEFT JOIN f ON f.path = i.raw_path WHERE status = 'present' AND (f.path IS NULL OR i.sha256 IS DISTINCT FROM f.sha256)"""
)
def lint_v01_v02(spark: SparkSession, d: str) -> DataFrame:
    """Present items without their file, or with other contents."""
    return lint.v01_v02(table(spark, d, "items"), _disk(spark, d))


@query(f"WITH f AS ({_DISK}) SELECT DISTINCT 'E' AS severity, 'V03' AS code, 'file that no item names' AS message, path AS place FROM f WHERE path NOT IN (SELECT raw_path FROM items WHERE raw_path IS NOT NULL UNION SELECT unnest(derived_paths) FROM items)")
def lint_v03(spark: SparkSession, d: str) -> DataFrame:
    """Files that no item names."""
    return lint.v03(table(spark, d, "items"), _disk(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per item that links to its file, to a part of it, and out."""
    link = F.concat(F.lit("See ["), "id", F.lit("]("), X.url_path(F.col("raw_path")), F.lit(") and [part]("), X.url_path(F.col("raw_path")), F.lit("#p1), [site](https://x.test/a) or [mail](mailto:a@x.test)."))
    return table(spark, d, "items").where("raw_path is not null").select(F.col("id").alias("doc"), link.alias("text"))


@query("SELECT DISTINCT id AS doc, raw_path AS target FROM items WHERE raw_path IS NOT NULL")
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages to files, read back from encoded markdown."""
    return files.markdown_links(_pages(spark, d))


@query(f"WITH f AS ({_DISK}) SELECT DISTINCT 'E' AS severity, 'V04' AS code, 'link without target' AS message, id || ' -> ' || raw_path AS place FROM items WHERE raw_path IS NOT NULL AND raw_path NOT IN (SELECT path FROM f)")
def lint_v04(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages that lead to no file."""
    return lint.v04(files.markdown_links(_pages(spark, d)), _disk(spark, d))


@query(f"WITH f AS ({_DISK}) SELECT 'W' AS severity, 'V06' AS code, 'file has come' AS message, id AS place FROM items WHERE status = 'missing' AND raw_path IN (SELECT path FROM f)")
def lint_v06_appeared(spark: SparkSession, d: str) -> DataFrame:
    """Missing items whose file has come."""
    return lint.v06_appeared(table(spark, d, "items"), _disk(spark, d))


@query(
    f"""WITH f AS ({_DISK}) SELECT 'E' AS severity, 'V07' AS code, 'required file is not there' AS message, path AS place FROM (VALUES ('MANIFEST.json'), ('INDEX.md'), ('summaries/attachments-summary.md'), ('summaries/conventions.md'), ('summaries/findings-log.md'), ('summaries/redactions.md')) t(path) WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT DISTINCT 'E', 'V11', 'outside the allowed zones', split_part(path, '/', 1) FROM f WHERE split_part(path, '/', 1) NOT IN ('MANIFEST.json', 'INDEX.md', 'summaries', 'raw') AND path NOT LIKE '.%'"""
)
def lint_v07_v11(spark: SparkSession, d: str) -> DataFrame:
    """What an archive lacks, and what lies at its top without leave."""
    return lint.v07(_disk(spark, d)).unionByName(lint.v11(_disk(spark, d)))


_REDACTIONS = """SELECT CASE WHEN id LIKE '%99' THEN left(id, 9) ELSE id END AS id, reason, CASE WHEN id LIKE '%3' THEN ' ' ELSE was END AS description, right(id, 1) IN ('0', '2', '4', '6') AS reversible,
CASE right(id, 1) WHEN '2' THEN 'vault/' || id WHEN '4' THEN '../vault/' || id WHEN '6' THEN '/vault/' || id WHEN '8' THEN 'a/../../' || id END AS vault_ref FROM retired"""


@query(
    f"""WITH r AS ({_REDACTIONS}) SELECT 'E' AS severity, 'V15' AS code, 'id repeated' AS message, id AS place FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'E', 'V15', 'reason outside its domain', id FROM r WHERE NOT coalesce(reason IN ('pii', 'off-topic', 'leaked-internal', 'client-confidential'), false)
UNION ALL SELECT 'E', 'V15', 'no description', id FROM r WHERE {_BLANK.format('description')} UNION ALL SELECT 'E', 'V15', 'no place of the original', id FROM r WHERE reversible AND vault_ref IS NULL
UNION ALL SELECT 'E', 'V15', 'original inside the archive', id FROM r WHERE vault_ref LIKE 'vault/%'"""
)
def lint_v15(spark: SparkSession, d: str) -> DataFrame:
    """Redactions that break their contract."""
    last = F.right("id", F.lit(1))
    ref = F.when(last == "2", F.concat(F.lit("vault/"), "id")).when(last == "4", F.concat(F.lit("../vault/"), "id")).when(last == "6", F.concat(F.lit("/vault/"), "id")).when(last == "8", F.concat(F.lit("a/../../"), "id"))
    rows = table(spark, d, "retired").select(
        F.when(F.col("id").like("%99"), F.left("id", F.lit(9))).otherwise(F.col("id")).alias("id"), "reason", F.when(F.col("id").like("%3"), " ").otherwise(F.col("was")).alias("description"),
        last.isin("0", "2", "4", "6").alias("reversible"), ref.alias("vault_ref"),
    )
    return lint.v15(rows)


@query("SELECT 'E' AS severity, 'V18' AS code, 'needs ' || version AS message, '1.4' AS place FROM (" + ORACLE["required_version"] + ") WHERE version IN ('1.5', '1.7')")
def lint_v18(spark: SparkSession, d: str) -> DataFrame:
    """An archive that declares version 1.4 and has sections of later ones."""
    return lint.v18(spark.createDataFrame([("1.4",)], "version string"), _sections(spark, d))


_V19 = f"""WITH RECURSIVE r AS (SELECT {_ID.format("id")} AS id, quote, {_ID.format("supersedes")} AS target FROM requirements WHERE {_ID.format("id")} IS NOT NULL),
e AS (SELECT id, min(target) AS up FROM r GROUP BY 1), ok AS (SELECT a.id, a.up FROM e a JOIN e b ON a.up = b.id), w AS (SELECT id, up AS tip FROM ok UNION SELECT w.id, ok.up FROM w JOIN ok ON ok.id = w.tip)
SELECT 'E' AS severity, 'V19' AS code, 'id repeated' AS message, id AS place FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'E', 'V19', 'no quote', id FROM r WHERE {_BLANK.format("quote")}
UNION ALL SELECT DISTINCT 'E', 'V19', 'replaces unknown ' || target, id FROM r WHERE target IS NOT NULL AND target NOT IN (SELECT id FROM r)
UNION ALL SELECT DISTINCT 'E', 'V19', 'replaces itself', id FROM r WHERE target = id
UNION ALL SELECT DISTINCT 'E', 'V19', 'cycle', cycle FROM (SELECT id, min(tip) AS cycle FROM w WHERE id IN (SELECT id FROM w WHERE id = tip) GROUP BY 1)"""


@query(_V19)
def lint_v19(spark: SparkSession, d: str) -> DataFrame:
    return lint.v19(table(spark, d, "requirements"), _cycles(spark, d).select("cycle").distinct())


@query("SELECT code, severity, count(*) AS violations FROM (" + " UNION ALL ".join(f"({x})" for x in _LINT.values()) + f" UNION ALL ({_V19})) GROUP BY 1, 2")
def lint_all(spark: SparkSession, d: str) -> DataFrame:
    """Violations per rule."""
    return _violations(spark, d).groupBy("code", "severity").agg(F.count("*").alias("violations"))


def _violations(spark: SparkSession, d: str) -> DataFrame:
    items, disk = table(spark, d, "items"), _disk(spark, d)
    parts = [lint.v05(items), lint.v06(items), lint.v10(items, AS_OF), lint.v13(items), lint.v16(table(spark, d, "people")), lint.v17(items)]
    parts.append(lint.v19(table(spark, d, "requirements"), _cycles(spark, d).select("cycle").distinct()))
    parts += [lint.v01_v02(items, disk), lint.v03(items, disk), lint.v06_appeared(items, disk), lint.v07(disk), lint.v11(disk)]
    parts += [lint_v04(spark, d), lint_v09(spark, d), lint_v14(spark, d), lint_v15(spark, d), lint_v18(spark, d)]
    return lint.union(parts)


_EVERY = [*_LINT.values(), _V19, *(ORACLE[f"lint_{v}"] for v in ("v01_v02", "v03", "v04", "v06_appeared", "v07_v11", "v09", "v14", "v15", "v18"))]
ORACLE["lint_all"] = "SELECT code, severity, count(*) AS violations FROM (" + " UNION ALL ".join(f"(SELECT severity, code, message, place FROM ({x}))" for x in _EVERY) + ") GROUP BY 1, 2"


@query("SELECT errors = 0 AS ok, errors, warnings, errors = 0 AND warnings = 0 AS passes FROM (SELECT count(*) FILTER (severity = 'E') AS errors, count(*) FILTER (severity = 'W') AS warnings FROM (" + " UNION ALL ".join(f"(SELECT severity FROM ({x}))" for x in _EVERY) + "))")
def lint_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether the archive passes all rules, in strict mode."""
    return lint.report(_violations(spark, d), strict=True)


# --- text functions ----------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({_COLLAPSE.format('text')}) AS collapsed, length({_COLLAPSE.format('text')}) AS chars FROM documents WHERE text IS NOT NULL")
def ws_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Documents with white space collapsed, as fingerprints."""
    clean = X.collapse(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(clean).alias("collapsed"), F.length(clean).cast("long").alias("chars"))


@query(f"SELECT DISTINCT author, {_NAME_KEY.format('author')} AS key FROM messages WHERE author IS NOT NULL")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Authors in comparable form."""
    return table(spark, d, "messages").where("author is not null").select("author").distinct().select("author", X.name_key(F.col("author")).alias("key"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?m)^([ \t]*)([#*+=|-]|[0-9]+[.)]|`{3,}|~{3,})', '\1\\\2', 'g')) AS escaped FROM documents WHERE text IS NOT NULL"""
)
def escape_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents escaped for markdown, as fingerprints."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.escape_markdown(F.col("text"))).alias("escaped"))


@query("SELECT id, replace(replace(quote, '|', '\\|'), chr(10), ' ') AS cell FROM requirements")
def cell_escape(spark: SparkSession, d: str) -> DataFrame:
    """Quotes for cells of a table."""
    return table(spark, d, "requirements").select("id", X.escape_cell(F.col("quote")).alias("cell"))


@query(
    f"""SELECT id, CASE WHEN length(t) <= 40 THEN t ELSE CASE WHEN strpos(left(t, 40), ' ') > 0 THEN regexp_extract(left(t, 40), '(?s)^(.*) ', 1) ELSE left(t, 40) END || '…' END AS short
FROM (SELECT id, {_COLLAPSE.format("quote")} AS t FROM requirements)"""
)
def word_cut(spark: SparkSession, d: str) -> DataFrame:
    """Quotes cut at a word."""
    return table(spark, d, "requirements").select("id", X.cut_at_word(F.col("quote"), 40).alias("short"))


@query("SELECT x AS ref, coalesce(regexp_matches(x, '^ctx:[a-z0-9][a-z0-9-]*#[a-z][0-9]{3,}$'), false) AS other_archive, count(*) AS n FROM (SELECT unnest(based_on) AS x FROM requirements) GROUP BY 1, 2")
def ctx_references(spark: SparkSession, d: str) -> DataFrame:
    """References, and whether they point into another archive."""
    rows = table(spark, d, "requirements").select(F.explode("based_on").alias("ref"))
    return rows.groupBy("ref", X.context_reference(F.col("ref")).alias("other_archive")).agg(F.count("*").alias("n"))


@query(f"SELECT id, {_DAY.format('date')} AS day, {_DAY.format('imported')} AS imported_day FROM items")
def strict_day(spark: SparkSession, d: str) -> DataFrame:
    """Days of items."""
    return table(spark, d, "items").select("id", day(F.col("date")).alias("day"), day(F.col("imported")).alias("imported_day"))


@query("SELECT DISTINCT raw_path, replace(url_encode(raw_path), '%2F', '/') AS url FROM items WHERE raw_path IS NOT NULL")
def url_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths as URLs."""
    return table(spark, d, "items").where("raw_path is not null").select("raw_path").distinct().select("raw_path", X.url_path(F.col("raw_path")).alias("url"))


_SLUG = "lower(" + _TRIM.format("display") + ")"
for _letter, _latin in X.SLUG_LETTERS.items():
    _SLUG = f"replace({_SLUG}, '{_letter}', '{_latin}')"
_SLUG = f"regexp_replace(regexp_replace(regexp_replace(strip_accents({_SLUG}), '[^\\p{{L}}a-z0-9]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g')"


@query(f"SELECT id, CASE WHEN display IS NOT NULL THEN coalesce(nullif(rtrim(left(trim({_SLUG}, '-'), 60), '-'), ''), 'unnamed') END AS slug FROM people")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """File-name forms of people's names."""
    return table(spark, d, "people").select("id", X.slugify(F.col("display")).alias("slug"))


@query(
    r"""SELECT id, list_aggregate(list_distinct(list_transform(list_filter(string_split(regexp_replace(lower(quote), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) > 2), lambda w: left(w, 5))), 'count')::INT AS stems
FROM requirements WHERE quote IS NOT NULL"""
)
def phrase_stems(spark: SparkSession, d: str) -> DataFrame:
    """How many different stems a quote has."""
    return table(spark, d, "requirements").where("quote is not null").select("id", F.size(X.stems(F.col("quote"))).alias("stems"))


_STEMS = r"list_sort(list_distinct(list_transform(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) > 2), lambda w: left(w, 5))))"


@query(
    f"""WITH t AS (SELECT quote AS text, min(id) AS id FROM requirements WHERE quote IS NOT NULL GROUP BY 1), b AS (SELECT id, {_STEMS} AS s FROM t),
q0 AS (SELECT quote AS text, min(id) AS id FROM requirements WHERE quote IS NOT NULL AND TRY_CAST(substr(id, 2) AS BIGINT) % 100 = 0 GROUP BY 1), q AS (SELECT id, {_STEMS} AS s FROM q0)
SELECT q.id AS query, b.id, round(len(list_intersect(q.s, b.s)) / least(len(q.s), len(b.s)), 9) AS overlap FROM q, b WHERE q.id <> b.id AND len(q.s) > 0 AND len(b.s) > 0 AND len(list_intersect(q.s, b.s)) / least(len(q.s), len(b.s)) >= 0.62"""
)
def similar_records(spark: SparkSession, d: str) -> DataFrame:
    """Quotes like those of every hundredth requirement, over all requirements; equal quotes are one."""
    rows = table(spark, d, "requirements").select("id", F.col("quote").alias("text"))
    asked = rows.where(F.substring("id", 2, 18).try_cast("long") % 100 == 0)
    return archive.similar_texts(asked, rows).withColumn("overlap", F.round("overlap", 9))


@query()
def similar_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Quotes like those of every hundredth requirement by stems or by characters, over all requirements, as classes."""
    rows = table(spark, d, "requirements").select("id", F.col("quote").alias("text"))
    asked = rows.where(F.substring("id", 2, 18).try_cast("long") % 100 == 0)
    return archive.alike_texts(asked.select(F.col("id"), "text"), rows)


_PHRASE = r"array_to_string(list_filter(string_split(regexp_replace(lower(quote), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) > 2), ' ')"


@query(f"SELECT DISTINCT id, min(id) OVER (PARTITION BY t) AS class FROM (SELECT id, {_PHRASE} AS t FROM requirements WHERE quote IS NOT NULL) WHERE t <> ''")
def similar_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of each requirement: the same words in the same order."""
    return archive.phrase_classes(table(spark, d, "requirements").select("id", F.col("quote").alias("text")))


@query(f"SELECT lower({_COLLAPSE.format('quote')}) AS text, min(id) AS first, count(DISTINCT id) AS records FROM requirements WHERE quote IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) > 1")
def batch_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Quotes that are the same but for case and white space."""
    rows = table(spark, d, "requirements").where("quote is not null").select("id", F.lower(X.collapse(F.col("quote"))).alias("text")).distinct()
    return rows.groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("records")).where("records > 1")


@query(
    """SELECT row_id, i - 1 AS line_no, nullif(trim(string_split(v, '::')[1]), '') AS text FROM (SELECT row_id, i, trim(regexp_replace(trim(x), '^[-* ]+', '')) AS v FROM (
SELECT row_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM messages WHERE text IS NOT NULL)) WHERE v <> '' AND v NOT LIKE '#%'"""
)
def batch_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of messages read as a list of records."""
    rows = table(spark, d, "messages").where("text is not null").select("row_id", F.posexplode(F.split("text", "\n")).alias("_i", "value"))
    lines = files.batch_lines(rows.select(F.struct("row_id", "_i").alias("line_no"), "value"))
    return lines.select("line_no.row_id", F.col("line_no._i").cast("long").alias("line_no"), "text")


def _paste(spark: SparkSession, d: str) -> DataFrame:
    """Pasted texts: the rows of a chat as lines with a stamp; a paste has no other way to date a row."""
    rows = _days(spark, d).where("author is not null and text is not null")
    stamp = F.coalesce(F.concat(F.lit("["), F.substring("day", 9, 2), F.lit("."), F.substring("day", 6, 2), F.lit("."), F.substring("day", 1, 4), F.lit(" "), F.col("clock"), F.lit("] ")), F.lit("[01.01.1970 00:00] "))
    whole = rows.select("row_id", F.posexplode(F.split(F.concat(stamp, F.regexp_replace("author", "\n", " "), F.lit(": "), "text"), "\n")).alias("_i", "value"))
    return whole.select(F.concat(F.lit("r"), F.col("row_id").cast("string")).alias("source"), F.col("_i").cast("long").alias("line_no"), "value")


@query()
def paste_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages read back from pasted texts."""
    return chats.parse_paste(_paste(spark, d))


@query(
    f"""SELECT (row_number() OVER (PARTITION BY chat_slug, day, row_id // 1000 ORDER BY row_id) - 1)::INT AS pos, date, coalesce(nullif(author, ''), 'unknown') AS author, coalesce(text, '') AS text, NULL::VARCHAR AS via,
nullif(media, '') AS media, CASE WHEN media <> '' THEN 'document' END AS media_kind, msg_id, reply_to, 'reliable' AS attribution, NULL::VARCHAR AS shown_as, 'tg' || chat_slug AS source_id FROM ({_DATED}) WHERE msg_id IS NOT NULL"""
)
def export_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages read back from messenger exports, one for each chat, day and thousand rows."""
    rows = _days(spark, d).where("msg_id is not null")
    fields = F.struct(F.col("msg_id").alias("id"), F.lit("message").alias("type"), "date", F.col("author").alias("from"), F.to_json(F.array(F.coalesce("text", F.lit("")))).alias("text"), F.col("media").alias("file"), F.col("reply_to").alias("reply_to_message_id"))
    export = rows.groupBy("chat_slug", "day", F.floor(F.col("row_id") / 1_000).alias("part")).agg(F.to_json(F.struct(F.first("chat_slug").alias("id"), F.transform(F.array_sort(F.collect_list(F.struct("row_id", fields.alias("m")))), lambda x: x["m"]).alias("messages"))).alias("value"))
    return chats.parse_export(export.select("value"))


@query("SELECT DISTINCT row_id AS doc, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]*[A-Za-z0-9/_-]')) AS url FROM messages WHERE text IS NOT NULL")
def web_links(spark: SparkSession, d: str) -> DataFrame:
    """Web addresses in messages."""
    return files.web_links(table(spark, d, "messages").select(F.col("row_id").alias("doc"), "text"))


@query()
def contained_paths(spark: SparkSession, d: str) -> DataFrame:
    """Attachments whose path leads out of its source, or nowhere."""
    return table(spark, d, "messages").where("media is not null").select("row_id", "media", X.contained_path(F.col("media")).alias("inside"))


@query("SELECT row_id, coalesce(text, '') || coalesce(author, '') AS plain FROM messages")
def rich_texts(spark: SparkSession, d: str) -> DataFrame:
    """Plain text of messages whose text comes as a list of texts and objects."""
    bold = F.struct(F.lit("bold").alias("type"), F.coalesce("author", F.lit("")).alias("text"))
    first = F.regexp_extract(F.to_json(F.array(F.coalesce("text", F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    value = F.concat(F.lit("["), first, F.lit(","), F.to_json(bold), F.lit("]"))
    return table(spark, d, "messages").select("row_id", X.rich_text(value).alias("plain"))


@query(f"SELECT row_id, replace({_COLLAPSE.format('text')}, '`', chr(39)) AS span FROM messages WHERE text IS NOT NULL")
def code_spans(spark: SparkSession, d: str) -> DataFrame:
    """Messages as inline code."""
    return table(spark, d, "messages").where("text is not null").select("row_id", X.inline_span(F.col("text")).alias("span"))

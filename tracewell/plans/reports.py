"""Queries of what people read, over whole tables, each beside the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.keys import message_number
from tracewell.functions.text import slugify
from tracewell.operators import archive, ingest, render
from tracewell.plans.archive import _COLLAPSE, _DATED, _REPLY, AS_OF, _days
from tracewell.session import table


def message_files(spark: SparkSession, d: str) -> DataFrame:
    """File name of each chat's day."""
    days = _days(spark, d).select("chat_slug", F.coalesce("day", F.lit("undated")).alias("day")).distinct()
    return days.select("chat_slug", "day", render.message_file(F.col("day"), F.col("chat_slug"), F.lit(None).cast("string")).alias("file"))


def late_segments(spark: SparkSession, d: str) -> DataFrame:
    """Files for what the odd batches bring after the even ones."""
    rows = _days(spark, d).select("batch_id", "chat_slug", F.coalesce("day", F.lit("undated")).alias("day"))
    new, old = (rows.where(F.col("batch_id") % 2 == k).select("chat_slug", "day") for k in (1, 0))
    return ingest.segments(new, old, F.lit(AS_OF))


def media_links(spark: SparkSession, d: str) -> DataFrame:
    """Attachments with the item file that is named like them."""
    files = table(spark, d, "items").where("raw_path is not null and status = 'present'").select(F.regexp_extract("raw_path", "([^/]+)$", 1).alias("name"), F.col("raw_path").alias("path"))
    rows = table(spark, d, "messages").select("row_id", F.regexp_extract("media", "([^/]+)$", 1).alias("media"))
    return ingest.media_links(rows, files.withColumnRenamed("name", "media"))


def leaked_terms(spark: SparkSession, d: str) -> DataFrame:
    """Projects that documents name by their first word."""
    listed = table(spark, d, "chats").where("project is not null").select(F.split("project", " ")[0].alias("term")).distinct()
    from tracewell.sources.files import leaked_terms as leaked

    return leaked(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), listed)


def chat_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slug of each chat's title beside the one it has."""
    return table(spark, d, "chats").select("chat_slug", slugify(F.col("title")).alias("from_title"))


def media_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes on doubtful authors."""
    rows = table(spark, d, "messages").select("row_id", render.media_note(F.col("attribution"), F.col("shown_as"), F.col("via")).alias("note"))
    return rows.where("note is not null")


def reply_heads(spark: SparkSession, d: str) -> DataFrame:
    """Markdown above the replies that carry a context."""
    rows = table(spark, d, "messages").where("reply_context is not null").select("row_id", ingest.reply_context(F.col("reply_context")).alias("c"))
    who = ingest.reply_authorship(F.col("c.kind"), F.col("c.origin_type"), F.col("c.origin_name"), F.col("c.author_name"))
    rows = rows.withColumn("w", who)
    number = message_number(F.col("c.message_id")).cast("string")
    return rows.select("row_id", render.reply_lines(F.col("w.name"), F.col("w.confirmed"), F.col("c.quote.text"), F.col("c.text"), number, F.lit(False)).alias("markdown"))


def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """The index."""
    return render.index_lines(*(table(spark, d, t) for t in ("items", "requirements", "people")))


def redaction_lines(spark: SparkSession, d: str) -> DataFrame:
    """The list of redactions."""
    return render.redaction_lines(table(spark, d, "items"))


def contract_lines(spark: SparkSession, d: str) -> DataFrame:
    """The read contract."""
    reqs = table(spark, d, "requirements")
    return render.contract_lines(reqs, archive.requirement_order(reqs, AS_OF))


def short_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes as a report lists them."""
    return render.short_quotes(table(spark, d, "requirements"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (message_files, late_segments, media_links, leaked_terms, chat_slugs, media_notes, reply_heads, index_lines, redaction_lines, contract_lines, short_quotes)
}
_MASKED = "CASE WHEN coalesce(len(redactions), 0) > 0 THEN '[redacted]' ELSE quote END"
ORACLE = {
    "late_segments": f"""SELECT n.chat_slug, n.day, n.day || '_' || n.chat_slug || CASE WHEN o.day IS NOT NULL THEN '_chat-{AS_OF}' ELSE '' END || '.md' AS file
FROM (SELECT DISTINCT chat_slug, coalesce(day, 'undated') AS day FROM ({_DATED}) WHERE batch_id % 2 = 1) n LEFT JOIN (SELECT DISTINCT chat_slug, coalesce(day, 'undated') AS day FROM ({_DATED}) WHERE batch_id % 2 = 0) o USING (chat_slug, day)""",
    "media_links": """SELECT row_id, regexp_extract(media, '([^/]+)$', 1) AS media, (SELECT min(raw_path) FROM items i WHERE i.status = 'present' AND regexp_extract(i.raw_path, '([^/]+)$', 1) = regexp_extract(m.media, '([^/]+)$', 1)) AS path
FROM messages m WHERE regexp_extract(media, '([^/]+)$', 1) <> ''""",
    "leaked_terms": r"""SELECT DISTINCT d.doc_id AS doc, t.term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_-]+')) AS w FROM documents) d
JOIN (SELECT DISTINCT string_split(project, ' ')[1] AS term FROM chats WHERE project IS NOT NULL) t ON lower(t.term) = d.w""",
    "message_files": f"SELECT DISTINCT chat_slug, coalesce(day, 'undated') AS day, coalesce(day, 'undated') || '_' || chat_slug || '.md' AS file FROM ({_DATED})",
    "media_notes": """SELECT row_id, 'authorship ' || attribution || CASE WHEN coalesce(shown_as, '') <> '' THEN '; shown as ' || shown_as ELSE '' END
|| CASE WHEN coalesce(via, '') <> '' THEN '; passed on by ' || via ELSE '' END AS note FROM messages WHERE coalesce(attribution, 'reliable') <> 'reliable'""",
    "reply_heads": f"""WITH r AS ({_REPLY}), w AS (SELECT r.row_id, kind, message_id, CASE kind WHEN 'message' THEN CASE WHEN coalesce(t, '') <> '' THEN n ELSE a END WHEN 'external' THEN n END AS name,
CASE kind WHEN 'message' THEN CASE WHEN coalesce(t, '') <> '' THEN t = 'user' AND n IS NOT NULL ELSE a IS NOT NULL END WHEN 'external' THEN coalesce(t = 'user', false) AND n IS NOT NULL ELSE false END AS ok,
json_extract_string(m.reply_context, '$.quote.text') AS q FROM r JOIN messages m USING (row_id))
SELECT row_id, '> in reply to ' || CASE WHEN name IS NULL THEN '—' WHEN ok THEN name ELSE name || ' (not confirmed)' END
|| coalesce(' #' || TRY_CAST(message_id AS BIGINT)::VARCHAR, '') || CASE WHEN coalesce(q, '') <> '' THEN chr(10) || '> ' || q ELSE '' END AS markdown FROM w""",
    "redaction_lines": "SELECT redaction, '| ' || redaction || ' | ' || count(*) || ' |' AS line FROM (SELECT DISTINCT id, unnest(redactions) AS redaction FROM items) GROUP BY 1",
    "short_quotes": f"""SELECT id, CASE WHEN length(t) <= 80 THEN t ELSE CASE WHEN strpos(left(t, 80), ' ') > 0 THEN regexp_extract(left(t, 80), '(?s)^(.*) ', 1) ELSE left(t, 80) END || '…' END AS line
FROM (SELECT id, {_COLLAPSE.format(_MASKED)} AS t FROM requirements)""",
    "index_lines": f"""WITH c AS (SELECT id, date, row_number() OVER (ORDER BY date, id) AS rank FROM (SELECT DISTINCT id, coalesce(date, '') AS date FROM items)),
z AS (SELECT id, min(source) AS source, min(fidelity) AS fidelity, min(CASE WHEN raw_path IS NULL THEN '—' WHEN regexp_matches(raw_path, '^raw/[^/]+/') THEN regexp_extract(raw_path, '^(raw/[^/]+)/', 1) ELSE 'raw' END) AS zone FROM items GROUP BY 1)
SELECT 1 AS section, 1::BIGINT AS rank, 'items: ' || count(DISTINCT id) AS line FROM items UNION ALL SELECT 1, 2, 'requirements: ' || count(DISTINCT id) FROM requirements UNION ALL SELECT 1, 3, 'people: ' || count(DISTINCT id) FROM people
UNION ALL SELECT 2, CASE coalesce(fidelity, 'placeholder') WHEN 'verbatim' THEN 1 WHEN 'reconstructed' THEN 2 WHEN 'digest' THEN 3 WHEN 'placeholder' THEN 4 ELSE 5 END, '| ' || coalesce(fidelity, 'placeholder') || ' | ' || count(*) || ' |' FROM items GROUP BY coalesce(fidelity, 'placeholder'), 2
UNION ALL SELECT 3, rank, '| ' || coalesce(nullif(date, ''), '—') || ' | ' || id || ' | ' || coalesce(source, '—') || ' | ' || coalesce(fidelity, '—') || ' | ' || zone || ' |' FROM c JOIN z USING (id)
UNION ALL SELECT 4, rank, '| ' || id || ' | ' || coalesce(status, '—') || ' | ' || coalesce(raw_path, '—') || ' |' FROM (SELECT DISTINCT id, status, raw_path FROM items WHERE status IS DISTINCT FROM 'present') JOIN c USING (id)""",
}

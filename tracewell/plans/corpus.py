"""Queries of the general problems (1, 2, 4, 7) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.keys import record_id
from tracewell.functions.zones import ABBREVIATIONS
from tracewell.operators import dedup, hierarchy, orphans, timestamps
from tracewell.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that repeat a message."""
    return dedup.redundant_rows(table(spark, d, "messages"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """The kept row of every message."""
    return dedup.kept_rows(table(spark, d, "messages")).select("chat_slug", "msg_no", "row_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The instant of every row whose date denotes one."""
    rows = table(spark, d, "messages").select("row_id", "chat_slug", "date")
    return timestamps.message_instants(rows, table(spark, d, "chats")).where("utc_us is not null").select("row_id", "utc_us")


def _requirement_tree(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.links(table(spark, d, "requirements"), record_id(F.col("id")), record_id(F.col("supersedes")))
    linked = nodes.where("parent is not null").select(F.explode(F.array("id", "parent")).alias("_in")).distinct()
    return hierarchy.hierarchy(nodes.join(linked, F.col("id") == F.col("_in"), "left_semi"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Depth and root of every requirement in a line of more than one."""
    return _requirement_tree(spark, d).select("id", F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root, and number of descendants, of every requirement whose line ends."""
    tree = _requirement_tree(spark, d)
    steps = hierarchy.paths(tree).withColumnRenamed("id", "_id")
    return tree.join(steps, F.col("id") == F.col("_id")).select("id", F.array_join("path", "/").alias("path"), "depth", "descendants")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every requirement with each one that descends from it."""
    return hierarchy.descendants(hierarchy.paths(_requirement_tree(spark, d)))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*(table(spark, d, t) for t in ("items", "requirements", "retired", "messages")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct reference without a target in time."""
    return _orphans(spark, d).drop("at")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per field, month and cause."""
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p2_found, p4_found, p4_paths, p4_descendants, p7_found, p7_report)}

_MESSAGES = r"""
WITH numbered AS (
  SELECT row_id, chat_slug, received_at,
         TRY_CAST(regexp_extract(msg_id, '^\s*(?:[^:]*:)?\s*0*([0-9]{1,19})(?:\.0*)?\s*$', 1) AS BIGINT) AS msg_no,
         TRY_CAST(regexp_extract(reply_to, '^\s*(?:[^:]*:)?\s*0*([0-9]{1,19})(?:\.0*)?\s*$', 1) AS BIGINT) AS reply_no
  FROM messages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY chat_slug, msg_no ORDER BY received_at, row_id) AS rn
  FROM numbered WHERE msg_no IS NOT NULL)
"""
_ABBREVIATION = " ".join(f"WHEN '{name}' THEN {minutes}" for name, minutes in ABBREVIATIONS.items())
#: row_id, utc_us and local (a timestamp of the chat's clock) of every row of messages; DuckDB's own calendar and zones.
INSTANTS = rf"""
SELECT row_id, utc_us, CASE WHEN tz IS NULL THEN make_timestamp(utc_us) ELSE make_timestamptz(utc_us) AT TIME ZONE tz END AS local FROM (
SELECT row_id, tz, CASE WHEN regexp_full_match(s, '[0-9]{{10}}') THEN s::BIGINT * 1000000 WHEN regexp_full_match(s, '[0-9]{{13}}') THEN s::BIGINT * 1000 WHEN regexp_full_match(s, '[0-9]{{16}}') THEN s::BIGINT
  WHEN minutes IS NOT NULL THEN epoch_us(clock) - minutes::BIGINT * 60000000
  WHEN (make_timestamptz(epoch_us(clock AT TIME ZONE zone) - 3600000000) AT TIME ZONE zone) = clock THEN epoch_us(clock AT TIME ZONE zone) - 3600000000
  ELSE epoch_us(clock AT TIME ZONE zone) END AS utc_us
FROM (SELECT *, TRY_CAST(y || '-' || CASE WHEN regexp_full_match(m, '[0-9]+') THEN m
    ELSE ((greatest(strpos('jan feb mar apr may jun jul aug sep oct nov dec', lower(left(m, 3))), strpos('янв фев мар апр мая июн июл авг сен окт ноя дек', lower(left(m, 3)))) + 3) // 4)::VARCHAR END || '-' || d || ' ' ||
    CASE WHEN h = '' THEN '00' WHEN ap = '' THEN h ELSE (h::INT % 12 + CASE ap WHEN 'PM' THEN 12 ELSE 0 END)::VARCHAR END || ':' || CASE WHEN mi = '' THEN '00' ELSE mi END || ':' || CASE WHEN sec = '' THEN '00' ELSE sec END || '.' || CASE WHEN f = '' THEN '0' ELSE f END AS TIMESTAMP) AS clock,
  CASE WHEN regexp_full_match(z, '(?:UTC|GMT)?[+-][0-9]{{1,2}}(?::?[0-9]{{2}})?') THEN CASE WHEN contains(z, '-') THEN -1 ELSE 1 END * (regexp_extract(z, '[+-]([0-9]{{1,2}})', 1)::INT * 60 + coalesce(TRY_CAST(regexp_extract(z, '[+-][0-9]{{2}}:?([0-9]{{2}})$', 1) AS INT), TRY_CAST(regexp_extract(z, '[0-9]:([0-9]{{2}})$', 1) AS INT), 0))
    ELSE CASE z {_ABBREVIATION} END END AS minutes,
  CASE WHEN z = '' THEN tz WHEN regexp_full_match(z, '\[?[A-Za-z]+/[A-Za-z/_]+\]?') THEN trim(z, '[]') END AS zone
FROM (SELECT row_id, tz, s, p.y, p.m, p.d, p.h, p.mi, p.sec, p.f, p.ap, trim(p.z) AS z FROM (
SELECT row_id, tz, s, regexp_extract(iso, '^([0-9]{{4}})[-/]([0-9]{{1,2}}|\p{{L}}+)[-/]([0-9]{{1,2}})(?:(?:T|,? )([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.]([0-9]{{1,6}}))?)? ?(AM|PM)?(.*))?$', ['y', 'm', 'd', 'h', 'mi', 'sec', 'f', 'ap', 'z']) AS p FROM (
SELECT row_id, tz, s, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
  '^([0-9]{{1,2}})[.]([0-9]{{1,2}})[.]([0-9]{{4}})', '\3-\2-\1'), '^([0-9]{{1,2}})[.]([0-9]{{1,2}})[.]([0-9]{{2}})(,| |$)', '20\3-\2-\1\4'), '^(?:\p{{L}}+, )?([0-9]{{1,2}}) (\p{{L}}+) ([0-9]{{4}})', '\3-\2-\1'),
  '^(\p{{L}}+) ([0-9]{{1,2}}), ([0-9]{{4}})', '\3-\1-\2'), '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})T([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})', '\1-\2-\3T\4:\5:\6') AS iso
FROM (SELECT row_id, trim(date) AS s, tz FROM messages LEFT JOIN (SELECT chat_slug, min(tz_name) AS tz FROM chats GROUP BY 1) USING (chat_slug)))))))"""
_DAY = "CASE WHEN regexp_matches(trim({0}), '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN TRY_CAST(trim({0}) AS DATE) END"
_ID = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_ORPHANS = (
    _MESSAGES
    + f""", kept AS (SELECT * FROM ranked WHERE rn = 1),
reqs AS (SELECT {_ID.format("id")} AS id, {_DAY.format("date")} AS ts, based_on, supersedes FROM requirements),
refs AS (
  SELECT ref_field, from_key, to_key, min(ts)::TIMESTAMP AS ts FROM (
    SELECT 'based_on' AS ref_field, id AS from_key, {_ID.format("x")} AS to_key, ts FROM (SELECT id, ts, unnest(based_on) AS x FROM reqs)
    UNION ALL SELECT 'supersedes', id, {_ID.format("supersedes")}, ts FROM reqs)
  WHERE to_key IS NOT NULL AND to_key NOT LIKE 'ctx:%' GROUP BY ALL
  UNION ALL
  SELECT 'reply_to', chat_slug || ':' || msg_no, chat_slug || ':' || reply_no, received_at FROM kept WHERE reply_no IS NOT NULL),
targets AS (
  SELECT ref_field, to_key, min(since) AS since FROM (
    SELECT 'based_on' AS ref_field, {_ID.format("id")} AS to_key, ({_DAY.format("imported")})::TIMESTAMP AS since FROM items
    UNION ALL SELECT 'supersedes', id, ts::TIMESTAMP FROM reqs
    UNION ALL SELECT 'reply_to', chat_slug || ':' || msg_no, received_at FROM kept) GROUP BY ALL),
gone AS (SELECT DISTINCT {_ID.format("id")} AS to_key FROM retired),
judged AS (
  SELECT r.*, CASE WHEN t.to_key IS NULL THEN CASE WHEN g.to_key IS NULL THEN 'missing' ELSE 'deleted' END
                   WHEN t.since > r.ts THEN 'late' END AS cause
  FROM refs r LEFT JOIN targets t USING (ref_field, to_key) LEFT JOIN gone g USING (to_key))
"""
)
_TREE = f"""
WITH RECURSIVE rows AS (
  SELECT {_ID.format("id")} AS id, min({_ID.format("supersedes")}) AS parent FROM requirements GROUP BY 1),
edges AS (SELECT a.id, a.parent FROM rows a JOIN rows b ON a.parent = b.id),
nodes AS (SELECT id FROM edges UNION SELECT parent FROM edges),
roots AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM edges)),
down AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth, id AS path FROM roots
  UNION ALL SELECT e.id, d.root_id, d.depth + 1, d.path || '/' || e.id FROM down d JOIN edges e ON e.parent = d.id),
lost AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM down)),
walk AS (
  SELECT id, id AS at FROM lost
  UNION SELECT w.id, e.parent FROM walk w JOIN edges e ON e.id = w.at),
back AS (SELECT DISTINCT w.at AS id FROM walk w JOIN edges e ON e.id = w.at JOIN walk v ON v.id = e.parent AND v.at = w.at),
cycles AS (SELECT w.id, min(w.at) AS root_id FROM walk w JOIN back b ON b.id = w.at GROUP BY 1)
"""
ORACLE = {
    "p2_found": f"SELECT row_id, utc_us FROM ({INSTANTS}) WHERE utc_us IS NOT NULL",
    "p1_found": _MESSAGES + "SELECT row_id FROM ranked WHERE rn > 1",
    "p1_kept": _MESSAGES + "SELECT chat_slug, msg_no, row_id FROM ranked WHERE rn = 1",
    "p4_found": _TREE + "SELECT id, root_id, depth FROM down UNION ALL SELECT id, root_id, -1 FROM cycles",
    "p4_paths": _TREE
    + """, kin AS (SELECT id, unnest(string_split(path, '/')) AS up FROM down)
SELECT d.id, d.path, d.depth, k.n - 1 AS descendants FROM down d JOIN (SELECT up, count(*) AS n FROM kin GROUP BY 1) k ON k.up = d.id""",
    "p4_descendants": _TREE
    + """, kin AS (SELECT id, depth, unnest(string_split(path, '/')) AS up FROM down)
SELECT k.up AS ancestor, k.id AS descendant, (k.depth - d.depth)::INT AS distance FROM kin k JOIN down d ON d.id = k.up WHERE k.up <> k.id""",
    "p7_found": _ORPHANS + "SELECT ref_field, from_key, to_key, cause FROM judged WHERE cause IS NOT NULL",
    "p7_report": _ORPHANS + "SELECT ref_field, strftime(ts, '%Y-%m') AS month, cause, count(*) AS orphans FROM judged WHERE cause IS NOT NULL GROUP BY ALL",
}

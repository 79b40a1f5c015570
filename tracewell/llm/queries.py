"""Queries of the problems tagged llm, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import conversations, leakage, linkage, packing, pii, reading, tokens
from tracewell.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of people that are one, and authors with the rows they stand for."""
    return linkage.links(table(spark, d, "people"), table(spark, d, "messages"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Each row of people with its person or organisation."""
    return linkage.entities(table(spark, d, "people"))[0]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages").select(F.lit("messages").alias("tbl"), F.col("row_id").cast("string").alias("rec_id"), "text")
    quotes = table(spark, d, "requirements").select(F.lit("requirements").alias("tbl"), F.col("id").alias("rec_id"), F.col("quote").alias("text"))
    return messages.unionByName(quotes.distinct())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every place of personal information in messages and quotes."""
    return pii.places(_texts(spark, d), table(spark, d, "people"))


def p5_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """Messages and quotes with placeholders."""
    texts = _texts(spark, d)
    return pii.replace(texts, pii.places(texts, table(spark, d, "people")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every message of every whole conversation with its turn."""
    rows = conversations.conversation_rows(table(spark, d, "messages"), table(spark, d, "chats"))
    return rows.select("chat_slug", "root_no", "msg_no", F.col("turn").cast("long").alias("turn"))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with author, role and level; roles by the linkage of names."""
    messages, people = table(spark, d, "messages"), table(spark, d, "people")
    links = linkage.links(people, messages).where("kind = 'author'").select(F.col("left_key").alias("author"), F.col("right_key").alias("id"))
    return conversations.with_roles(conversations.conversation_rows(messages, table(spark, d, "chats")), people, links)


def p6_endless(spark: SparkSession, d: str) -> DataFrame:
    """Messages on a cycle of replies, or that answer one."""
    return conversations.endless_rows(table(spark, d, "messages"))


def p6_alternation(spark: SparkSession, d: str) -> DataFrame:
    """Turns, speakers, changes of speaker and of role per conversation."""
    return conversations.alternation(p6_turns(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), tokens.token_count(F.col("text")).alias("tokens"))
    return packing.pack(rows, table(spark, d, "context_windows"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a long one, with its window, for each kind of window."""
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the windows are."""
    return packing.fill(_packed(spark, d), table(spark, d, "context_windows"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document with each evaluation item that leaked into it."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents per leaked item."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The level of every running text."""
    return _levels(spark, d).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Texts per source and level."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return _levels(spark, d).join(docs, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("texts"))


QUERIES = {f.__name__: f for f in (p3_found, p3_members, p5_found, p5_sanitised, p6_found, p6_turns, p6_endless, p6_alternation, p8_packing, p8_fill, p9_found, p9_report, p10_found, p10_profile)}
ORACLE = {
    "p6_endless": r"""WITH RECURSIVE n AS (SELECT row_id, chat_slug, received_at,
  TRY_CAST(regexp_extract(msg_id, '^\s*(?:[^:]*:)?\s*0*([0-9]{1,19})(?:\.0*)?\s*$', 1) AS BIGINT) AS no, TRY_CAST(regexp_extract(reply_to, '^\s*(?:[^:]*:)?\s*0*([0-9]{1,19})(?:\.0*)?\s*$', 1) AS BIGINT) AS up FROM messages),
k AS (SELECT * FROM n WHERE no IS NOT NULL AND chat_slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chat_slug, no ORDER BY received_at, row_id) = 1),
e AS (SELECT a.chat_slug, a.no, a.up FROM k a JOIN k b ON a.chat_slug = b.chat_slug AND a.up = b.no),
down AS (SELECT chat_slug, no FROM k WHERE (chat_slug, no) NOT IN (SELECT (chat_slug, no) FROM e) UNION ALL SELECT e.chat_slug, e.no FROM down d JOIN e ON e.chat_slug = d.chat_slug AND e.up = d.no)
SELECT chat_slug, no AS msg_no, up AS reply_no FROM e WHERE (chat_slug, no) NOT IN (SELECT (chat_slug, no) FROM down)""",
}

"""Rebuilding conversations from message rows.

Replies form one graph per chat. It is sorted topologically as Kahn's algorithm does, from the openings downwards, but
with twice as many levels released in each round; what is never released is a cycle. Conversations are then checked as
groups with combining aggregates only, and turns are numbered by time without gathering a conversation in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.keys import message_number, strip
from tracewell.operators.dedup import kept_rows
from tracewell.operators.hierarchy import climb
from tracewell.operators.ranking import positions
from tracewell.operators.timestamps import message_instants
from tracewell.session import checkpoint

#: Fixed value: the account name that stands for nobody.
NOBODY = "Deleted Account"


def reply_graph(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, ended, endless): kept rows with reply_no, has_reply, has_text; (id, root, level) of the replies whose line
    ends, by row_id; (id) of those on a cycle of replies, or whose line runs into one."""
    has_reply = F.coalesce(strip(F.col("reply_to")) != "", F.lit(False)).alias("has_reply")
    has_text = F.coalesce(strip(F.col("text")) != "", F.lit(False)).alias("has_text")
    kept = kept_rows(messages, message_number(F.col("reply_to")).alias("reply_no"), has_reply, has_text)
    kept = checkpoint(kept.where("chat_slug is not null").drop("received_at"))
    parents = kept.select("chat_slug", F.col("msg_no").alias("reply_no"), F.col("row_id").alias("parent"))
    replies = kept.where("reply_no is not null").select("chat_slug", "reply_no", F.col("row_id").alias("id"))
    return kept, *climb(replies.join(parents, ["chat_slug", "reply_no"]).select("id", "parent"))


def endless_rows(messages: DataFrame) -> DataFrame:
    """(chat_slug, msg_no, reply_no) of the messages that Kahn's algorithm never releases: replies on a cycle, or that
    answer one. They belong to no conversation."""
    kept, _, endless = reply_graph(messages)
    return kept.join(endless, F.col("row_id") == F.col("id"), "left_semi").select("chat_slug", "msg_no", "reply_no")


def conversation_rows(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """One row per message of a whole conversation: chat_slug, root_no, msg_no, row_id, author, level, utc_us, turn.

    A conversation is all messages of a chat connected by ``reply_to``, taken from the kept rows. It is dropped if a
    reply names a message that does not exist (or no number at all), if it has no single opening message, if a date
    denotes no instant, if no row has text other than white space, or if fewer than two authors speak (null and
    ``Deleted Account`` do not count; spellings count as they are). Rows with a null chat are left out; row_id must be unique. turn counts
    from 1 by instant, then number; level is the topological level, 0 for the opening.
    """
    kept, ended, _ = reply_graph(messages)
    openings = ended.select("root").distinct().select(F.col("root").alias("row_id"), "root", F.lit(0).alias("level"))
    placed = ended.select(F.col("id").alias("row_id"), "root", "level").unionByName(openings)
    texts = messages.select("row_id", "date", "author")
    rows = placed.join(kept.drop("reply_no"), "row_id").join(texts, "row_id")
    rows = checkpoint(message_instants(rows, chats).drop("date"))
    speaker = F.when(F.col("author") != NOBODY, F.col("author"))
    judged = rows.groupBy("root").agg(
        F.max((F.col("level") == 0) & F.col("has_reply")).alias("broken"),
        F.max(F.col("utc_us").isNull()).alias("undated"),
        F.max("has_text").alias("speaks"),
        F.coalesce(F.min(speaker) != F.max(speaker), F.lit(False)).alias("answered"),
        F.max(F.when(F.col("level") == 0, F.col("msg_no"))).alias("root_no"),
    )
    whole = judged.where("not broken and not undated and speaks and answered").select("root", "root_no")
    rows = rows.join(whole, "root").select("chat_slug", "root_no", "msg_no", "row_id", "author", "level", "utc_us")
    return positions(rows, ["chat_slug", "root_no"], ["utc_us", "msg_no"], "turn")


def with_roles(turns: DataFrame, people: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``turns`` with the author's ``role`` in people, null for unknown names.

    links (author, id) says for whom an author stands; of several rows the smallest id with a role counts. What it leaves
    open belongs to the first person (by id) whose display, id, alias or handle equals it without regard to case and white
    space at the ends.
    """
    clean = lambda c: F.nullif(F.lower(strip(c)), F.lit(""))
    none = F.array().cast("array<string>")
    handles = F.coalesce(F.map_values("handles"), none)
    names = F.array_union(F.array("display", "id"), F.concat(F.coalesce("aliases", none), handles))
    named = people.select("id", "role", F.explode(names).alias("_name")).withColumn("_name", clean(F.col("_name")))
    first = named.where("_name is not null").groupBy("_name").agg(F.min_by("role", "id").alias("_equal"))
    authors = turns.select("author").distinct().withColumn("_clean", clean(F.col("author")))
    roles = authors.join(first, F.col("_clean") == F.col("_name"), "left").select(F.col("author").alias("_author"), "_equal")
    if links is not None:
        staff = people.where("role is not null").groupBy("id").agg(F.min("role").alias("_role"))
        linked = links.join(staff, "id").groupBy(F.col("author").alias("_linked")).agg(F.min_by("_role", "id").alias("_role"))
        roles = roles.join(linked, F.col("_author") == F.col("_linked"), "left").select("_author", F.coalesce("_role", "_equal").alias("_equal"))
    return turns.join(roles, F.col("author") == F.col("_author"), "left").withColumn("role", F.col("_equal")).drop("_author", "_equal")


def alternation(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns with roles: turns, speakers counted once, how many turns answer another speaker,
    and how many another role.

    An unknown role is a role of its own. The neighbour of a turn is found by its number, so a long conversation is spread
    over tasks.
    """
    keys = ["chat_slug", "root_no"]
    before = turns.select(*keys, (F.col("turn") + 1).alias("turn"), F.struct("author", "role").alias("_before"))
    joined = turns.join(before, [*keys, "turn"], "left")
    changed = lambda c: F.count_if((F.col("turn") > 1) & ~F.col(c).eqNullSafe(F.col(f"_before.{c}")))
    return joined.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.count_distinct("author").alias("speakers"),
        changed("author").alias("changes"),
        changed("role").alias("role_changes"),
    )

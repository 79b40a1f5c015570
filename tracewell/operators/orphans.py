"""References to records that do not exist.

Parent keys (of tables and of the list of retired ids) and child keys are tagged and united in long form. One grouping
by parent table and key, combined before the shuffle, tells for each key whether a parent exists, since when, and
whether it was retired. References are then held against that one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.keys import day, message_number, record_id
from tracewell.operators.dedup import kept_rows

CHILD = "ref_field string, from_key string, to_key string, at timestamp_ntz, parent_table string"


def _instant(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def references(requirements: DataFrame, kept: DataFrame) -> DataFrame:
    """(ref_field, from_key, to_key, at, parent_table): each distinct reference once; at is its record's time.

    Blank references, those into other archives (``ctx:``) and references of records without a key are left out.
    A record that is repeated counts once, with the earliest known time.
    """
    reqs = requirements.select(record_id(F.col("id")).alias("from_key"), "based_on", "supersedes", _instant(day(F.col("date"))).alias("at"))
    based = reqs.select("from_key", "at", F.explode("based_on").alias("to_key")).select(
        F.lit("based_on").alias("ref_field"), "from_key", record_id(F.col("to_key")).alias("to_key"), "at", F.lit("items").alias("parent_table")
    )
    supers = reqs.select(F.lit("supersedes").alias("ref_field"), "from_key", record_id(F.col("supersedes")).alias("to_key"), "at", F.lit("requirements").alias("parent_table"))
    named = based.unionByName(supers).where("to_key not like 'ctx:%'")
    named = named.groupBy("ref_field", "from_key", "to_key", "parent_table").agg(F.min("at").alias("at"))
    replies = kept.select(
        F.lit("reply_to").alias("ref_field"), message_key(F.col("msg_no")).alias("from_key"), message_key(F.col("reply_no")).alias("to_key"),
        _instant(F.col("received_at")).alias("at"), F.lit("messages").alias("parent_table"),
    )
    return named.unionByName(replies).where("from_key is not null and to_key is not null")


def message_key(number: Column) -> Column:
    """``chat_slug:number`` without leading zeros; null without either."""
    return F.concat(F.col("chat_slug"), F.lit(":"), number.cast("string"))


def parents(items: DataFrame, requirements: DataFrame, retired: DataFrame, kept: DataFrame) -> DataFrame:
    """(parent_table, to_key, since, gone) in long form, one row per record."""
    alive = lambda df, name, key, at: df.select(F.lit(name).alias("parent_table"), key.alias("to_key"), _instant(at).alias("since"), F.lit(False).alias("gone"))
    dead = retired.select(record_id(F.col("id")).alias("to_key"))
    gone = dead.select(
        F.when(F.col("to_key").startswith("i"), "items").when(F.col("to_key").startswith("t"), "requirements").alias("parent_table"), "to_key",
        F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(True).alias("gone"),
    )
    return (
        alive(items, "items", record_id(F.col("id")), day(F.col("imported")))
        .unionByName(alive(requirements, "requirements", record_id(F.col("id")), day(F.col("date"))))
        .unionByName(alive(kept, "messages", message_key(F.col("msg_no")), F.col("received_at")))
        .unionByName(gone)
        .where("to_key is not null and parent_table is not null")
    )


def orphans(items: DataFrame, requirements: DataFrame, retired: DataFrame, messages: DataFrame) -> DataFrame:
    """(ref_field, from_key, to_key, cause, at): each distinct reference without a target in time.

    cause is ``deleted`` (not in its table, but retired), ``missing`` (in neither) or ``late`` (the target exists, but
    arrived after the record that refers to it; unknown times are never late). A record that is repeated counts with
    its earliest known time. Messages count by their kept rows.
    """
    kept = kept_rows(messages, message_number(F.col("reply_to")).alias("reply_no"))
    refs = references(requirements, kept)
    tagged = parents(items, requirements, retired, kept).select("parent_table", "to_key", "since", "gone", F.lit(True).alias("parent"))
    tagged = tagged.unionByName(
        refs.select("parent_table", "to_key", F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(False).alias("gone"), F.lit(False).alias("parent"))
    )
    keys = tagged.groupBy("parent_table", "to_key").agg(
        F.max(F.col("parent") & ~F.col("gone")).alias("exists"), F.max("gone").alias("gone"), F.min("since").alias("since"), F.max(~F.col("parent")).alias("wanted")
    )
    keys = keys.where("wanted and (not exists or since is not null)").drop("wanted")
    late = F.col("exists") & (F.col("since") > F.col("at"))
    cause = F.when(late, "late").when(~F.col("exists"), F.when(F.col("gone"), "deleted").otherwise("missing"))
    found = refs.join(keys, ["parent_table", "to_key"]).withColumn("cause", cause)
    return found.where("cause is not null").select("ref_field", "from_key", "to_key", "cause", "at")


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_field, month, cause, orphans): counts per field and month of the referring record; unknown months are null."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return found.groupBy("ref_field", month, "cause").agg(F.count("*").alias("orphans"))

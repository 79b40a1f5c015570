"""Reports over items and requirements: replacement, order, chronology, zones, slices, lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.keys import day, record_id
from tracewell.functions.text import distinct_list, overlap, stems, truthy, words_over_two
from tracewell.session import checkpoint

MASK = "[redacted]"


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, columns): one row per id; of repeats that differ the least in the order of the columns, nulls first."""
    least = F.min(F.struct(*(F.col(c) for c in columns))).alias("_once")
    return rows.groupBy("id").agg(least).select("id", "_once.*")


def superseded_by(requirements: DataFrame) -> DataFrame:
    """(id, superseded_by): of each replaced requirement the last (greatest id) that replaces it."""
    rows = requirements.select(record_id(F.col("id")).alias("by"), record_id(F.col("supersedes")).alias("id")).where("id is not null")
    return rows.groupBy("id").agg(F.max("by").alias("superseded_by"))


def blocked_days(blocking: Column, since: Column, date: Column, as_of: str) -> Column:
    """Days since something blocks: from ``since``, else from the record's date; null if nothing does or no day is known."""
    start = day(F.coalesce(F.nullif(since, F.lit("")), date))
    return F.when(truthy(blocking), F.date_diff(F.lit(as_of).cast("date"), start))


def requirement_order(requirements: DataFrame, as_of: str) -> DataFrame:
    """(id, days_blocked, rank): blocking ones first, the longest blocked before the others, then by date and id.

    A repeated row counts once. Ranks are given without gathering the table in one task.
    """
    from tracewell.operators.ranking import positions

    rows = once(requirements, "blocking", "blocking_since", "date").select(
        "id", blocked_days(F.col("blocking"), F.col("blocking_since"), F.col("date"), as_of).alias("days_blocked"), (~truthy(F.col("blocking"))).alias("_free"), F.coalesce("date", F.lit("")).alias("_date")
    )
    rows = rows.withColumn("_days", -F.coalesce("days_blocked", F.lit(0))).withColumn("_all", F.lit(1))
    return positions(rows, ["_all"], ["_free", "_days", "_date", "id"], "rank").select("id", "days_blocked", "rank")


def chronology(items: DataFrame) -> DataFrame:
    """(id, date, rank): items by date and id as text; without a date first."""
    from tracewell.operators.ranking import positions

    rows = once(items, "date").select("id", F.coalesce("date", F.lit("")).alias("date"), F.lit(1).alias("_all"))
    return positions(rows, ["_all"], ["date", "id"], "rank").select("id", "date", "rank")


def zone_of(path: Column) -> Column:
    """The zone a path lies in: its first two parts under ``raw/``, ``raw`` for others, ``—`` without a path."""
    zone = F.regexp_extract(path, r"^(raw/[^/]+)/", 1)
    return F.when(path.isNull(), F.lit("—")).when(zone != "", zone).otherwise(F.lit("raw"))


def zones(items: DataFrame) -> DataFrame:
    return items.groupBy(zone_of(F.col("raw_path")).alias("zone")).agg(F.count("*").alias("items"))


def gaps(items: DataFrame) -> DataFrame:
    """Items that are not there, each once."""
    return items.where(~F.col("status").eqNullSafe("present")).select("id", "status", "raw_path").distinct()


def histogram(items: DataFrame, column: str, domain: tuple[str, ...], default: str) -> DataFrame:
    """(level, rank, items) of the levels that occur; null counts as ``default``, unknown levels come last."""
    value = F.coalesce(F.col(column), F.lit(default))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, domain)), value), F.lit(0)), F.lit(len(domain) + 1))
    return items.groupBy(value.alias("level"), rank.cast("int").alias("rank")).agg(F.count("*").alias("items"))


def redaction_uses(items: DataFrame) -> DataFrame:
    """(redaction, items): how many items each redaction touches, an item counted once."""
    return items.select("id", F.explode("redactions").alias("redaction")).distinct().groupBy("redaction").agg(F.count("*").alias("items"))


def visible(text: Column, redactions: Column) -> Column:
    """The text, or a mask where the record has a redaction."""
    return F.when(F.coalesce(F.size(redactions), F.lit(0)) > 0, F.lit(MASK)).otherwise(text)


def public(items: DataFrame) -> DataFrame:
    """Items whose contour is ``public``; without a contour they are held back."""
    return items.where(F.col("contour").eqNullSafe("public"))


def held(items: DataFrame) -> DataFrame:
    return items.where(~F.col("contour").eqNullSafe("public"))


def slim(items: DataFrame) -> DataFrame:
    """What is published of an item: no participants, no notes of who handled it."""
    return public(items).select("id", "source", "date", "raw_path", "sha256", F.lit("public").alias("contour"), F.size(F.coalesce("derived_paths", F.array().cast("array<string>"))).alias("derived"))


def publish_counts(items: DataFrame) -> DataFrame:
    """(copied, derived, skipped) of the public items."""
    there = (F.col("status") == "present") & truthy(F.col("raw_path"))
    derived = F.when(there, F.greatest(F.coalesce(F.size("derived_paths"), F.lit(0)), F.lit(0))).otherwise(0)
    return public(items).agg(F.count_if(F.coalesce(there, F.lit(False))).alias("copied"), F.coalesce(F.sum(derived), F.lit(0)).alias("derived"), F.count_if(~F.coalesce(there, F.lit(False))).alias("skipped"))


def next_ids(live: DataFrame, retired: DataFrame) -> DataFrame:
    """(prefix, next): the first number after all ids, living and retired, of each prefix; at least three digits."""
    ids = live.select(record_id(F.col("id")).alias("id")).unionByName(retired.select(record_id(F.col("id")).alias("id")))
    shaped = ids.where(F.regexp_like("id", F.lit(r"^[a-z][0-9]{1,18}$"))).select(F.substring("id", 1, 1).alias("prefix"), F.substring("id", 2, 18).cast("long").alias("n"))
    number = (F.max("n") + 1).cast("string")
    return shaped.groupBy("prefix").agg(F.concat("prefix", F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("next"))


def lookup(buckets: list[tuple[str, DataFrame]], wanted: DataFrame) -> DataFrame:
    """(id, bucket): for each wanted id the first bucket, in the given order, that has it."""
    rows = None
    for i, (name, df) in enumerate(buckets):
        part = df.select(record_id(F.col("id")).alias("id"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("bucket")).alias("_b"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.where("id is not null").groupBy("id").agg(F.min("_b").alias("_b"))
    return wanted.select(record_id(F.col("id")).alias("id")).distinct().join(first, "id").select("id", "_b.bucket")


def item_defaults(items: DataFrame) -> DataFrame:
    """(id, attribution, participants, tags): fields that may be missing, with their defaults, lists without repetitions."""
    joined = lambda c: F.array_join(distinct_list(F.col(c)), "; ").alias(c)
    return items.select("id", F.coalesce("attribution", F.lit("reliable")).alias("attribution"), joined("participants"), joined("tags"))


def similar_texts(queries: DataFrame, texts: DataFrame, threshold: float = 0.62) -> DataFrame:
    """(query, id, overlap): texts of (id, text) that share at least this part of the smaller set of stems with a query.

    Equal texts are one class with the smallest id. Candidates meet in a stem of the smaller set's rarest ones: a set of
    n stems that shares k of them shares one of its n - k + 1 rarest, so nothing is lost and frequent stems stay out.
    Records without stems are like nothing.
    """
    base = texts.where("text is not null").groupBy("text").agg(F.min("id").alias("id")).withColumn("stems", stems(F.col("text"))).where(F.size("stems") > 0)
    asked = queries.where("text is not null").groupBy("text").agg(F.min("id").alias("query")).withColumn("stems", stems(F.col("text"))).where(F.size("stems") > 0)
    frequency = base.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))

    def ranked(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(key, F.explode("stems").alias("stem")).join(frequency, "stem", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "stem")))
        return rows.groupBy(key).agg(F.transform(order, lambda x: x.stem).alias("stems"))

    def heads(df: DataFrame, key: str) -> DataFrame:
        size = F.size("stems")
        head = F.slice("stems", 1, (size - F.ceil(size * threshold) + 1).cast("int"))
        return df.select(key, F.explode(head).alias("stem"))

    a, b = checkpoint(ranked(asked, "query")), checkpoint(ranked(base, "id"))
    whole = lambda df, key: df.select(key, F.explode("stems").alias("stem"))
    met = heads(a, "query").join(whole(b, "id"), "stem").select("query", "id").unionByName(whole(a, "query").join(heads(b, "id"), "stem").select("query", "id")).distinct()
    pairs = met.join(a.withColumnRenamed("stems", "_a"), "query").join(b.withColumnRenamed("stems", "_b"), "id")
    return pairs.withColumn("overlap", overlap(F.col("_a"), F.col("_b"))).where(F.col("overlap") >= threshold).where("query <> id").select("query", "id", "overlap")


#: Texts in a block of the comparison by characters, and queries in a block.
BLOCK_TEXTS, BLOCK_ASKED = 8_000, 1_000


def phrase_classes(texts: DataFrame) -> DataFrame:
    """(id, class) of (id, text): records whose words of more than two letters are the same, in their order, are one class,
    named after its smallest id. Records without such words have no class."""
    rows = texts.where("id is not null").select("id", F.array_join(words_over_two(F.col("text")), " ").alias("t")).where("t <> ''").distinct()
    low = rows.groupBy("t").agg(F.min("id").alias("class"))
    return rows.join(low, "t").select("id", "class").distinct()


def alike_texts(queries: DataFrame, texts: DataFrame, threshold: float = 0.62) -> DataFrame:
    """(query, id, similarity): classes of texts (id, text) that are like the class of a query, by stems or letters.

    queries (id, text) are some of the texts; classes are those of :func:`phrase_classes`, and the query's name is its class.
    Every query is held against every text, in blocks: a row of the comparison is a block of queries beside a block of
    texts, so nothing is collected and no pair is made that is not alike.
    """

    def blocks(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        rows = df.where("id is not null").select("id", F.array_join(words_over_two(F.col("text")), " ").alias("t"), stems(F.col("text")).alias("s")).where("t <> ''")
        rows = checkpoint(rows.groupBy("t").agg(F.min("id").alias("id"), F.first("s").alias("s")))
        n = max(1, -(-rows.count() // size))
        block = F.pmod(F.xxhash64("t"), F.lit(n)).alias(f"{name}_no")
        return checkpoint(rows.groupBy(block).agg(F.collect_list(F.struct("id", "t", "s")).alias(name))), n

    wanted = queries.where("id is not null").select(F.array_join(words_over_two(F.col("text")), " ").alias("_w")).distinct()
    asked, m = blocks(texts.join(wanted, F.array_join(words_over_two(F.col("text")), " ") == F.col("_w"), "left_semi"), "asked", BLOCK_ASKED)
    base, n = blocks(texts, "texts", BLOCK_TEXTS)
    every = asked.select("asked_no").agg(F.collect_list("asked_no").alias("all"), F.lit(1).alias("_one"))
    places = base.select("texts_no", F.lit(1).alias("_one")).join(F.broadcast(every), "_one").select("texts_no", F.explode("all").alias("asked_no"))  # numbers of blocks
    both = places.coalesce(1).join(asked, "asked_no").join(base, "texts_no").select("asked", "texts").repartition(m * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracewell.functions.alike import alike

        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].values, batch.column(1)[i].values
                pairs = (list(zip(x.field("t").to_pylist(), x.field("s").to_pylist())) for x in (a, b))
                for p, q, similarity in alike(*pairs, threshold):
                    out = pa.record_batch([a.field("id").take(pa.array(p)), b.field("id").take(pa.array(q)), pa.array(similarity)], names=["query", "id", "similarity"])
                    yield out.filter(pc.not_equal(out["query"], out["id"]))

    return both.mapInArrow(run, "query string, id string, similarity double")

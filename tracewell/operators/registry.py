"""The registry of people by exact names: resolution, strangers, clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.keys import strip
from tracewell.functions.text import name_key

NONE = "array<string>"


def candidate_names(people: DataFrame, clean) -> DataFrame:
    """(id, name, key): every display, id, alias and handle value of each person; blank keys are left out."""
    names = F.concat(F.array("display", "id"), F.coalesce("aliases", F.array().cast(NONE)), F.coalesce(F.map_values("handles"), F.array().cast(NONE)))
    rows = people.select("id", F.explode(names).alias("name")).where("name is not null")
    return rows.withColumn("key", clean(F.col("name"))).where("key <> ''")


def resolve(names: DataFrame, people: DataFrame) -> DataFrame:
    """(name, id): each distinct name with the first person (by id) that has it; id is null for strangers."""
    first = candidate_names(people, name_key).groupBy("key").agg(F.min("id").alias("id"))
    asked = names.where("name is not null").select("name").distinct().withColumn("_key", name_key(F.col("name")))
    return asked.join(first, F.col("_key") == F.col("key"), "left").select("name", "id")


def strangers(names: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct names that no person has."""
    return resolve(names.where("name <> ''"), people).where("id is null").select("name")


def _clashes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, id) whose key another person also has, with how many have it."""
    held = rows.select(*keys, "id").distinct().groupBy(*keys).agg(F.count("*").alias("people"), F.min("id").alias("first")).where("people > 1")
    return held


def alias_clashes(people: DataFrame) -> DataFrame:
    """(key, people, first): names (stripped, lower case) of more than one person."""
    names = F.concat(F.array("display", "id"), F.coalesce("aliases", F.array().cast(NONE)))
    rows = people.select("id", F.explode(names).alias("name")).where("name is not null").select("id", F.lower(strip(F.col("name"))).alias("key")).where("key <> ''")
    return _clashes(rows, ["key"])


def account_clashes(people: DataFrame) -> DataFrame:
    """(type, account, people, first): accounts of more than one person."""
    rows = people.select("id", F.explode("handles").alias("type", "name")).where("name is not null")
    rows = rows.select("id", "type", F.lower(strip(F.col("name"))).alias("account")).where("account <> ''")
    return _clashes(rows, ["type", "account"])


def conflicts_with_previous(rows: DataFrame, key: str, owner: str, order: str) -> DataFrame:
    """Rows whose key the row before it (by ``order``) gave to another owner."""
    before = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_before", F.lag(owner).over(before)).where(F.col("_before") != F.col(owner)).withColumnRenamed("_before", "previous")


def merge_person(old: Column, new: Column) -> Column:
    """Aliases after an update: the old ones, then the new ones that are not there yet."""
    return F.array_union(F.coalesce(old, F.array().cast(NONE)), F.coalesce(new, F.array().cast(NONE)))

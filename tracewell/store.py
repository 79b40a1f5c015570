"""The archive as snapshots of typed tables, changed as a whole or not at all.

Each change writes its tables to a folder of its own and then adds an entry to a log: a numbered file that names the
folder of every table. The last entry is the archive. A writer names the entry it started from; the next number can be
taken once only, so of two writers one is refused. Any file system that the cluster shares will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.paths import Folder

#: The relations of an archive and their columns.
TABLES = {
    "export": "slug string, title string, created string, project string, contour string, participants array<string>",
    "items": "id string, source string, origin string, fidelity string, fidelity_note string, date string, imported string, participants array<string>, raw_path string, sha256 string,"
    " derived_paths array<string>, attribution string, status string, summary_ref string, redactions array<string>, tags array<string>, project string, contour string",
    "redactions": "id string, reason string, description string, scope string, reversible boolean, vault_ref string, date string",
    "imports": "parser string, source string, imported string, messages bigint",
    "keys": "key string, batch bigint",
    "people": "id string, display string, role string, aliases array<string>, handles map<string,string>, note string",
    "retired": "id string, was string, reason string, date string",
    "requirements": "id string, quote string, wanted_by string, based_on array<string>, state string, evidence string, blocking string, blocking_since string, stage string, supersedes string,"
    " note string, redactions array<string>, date string",
    "questions": "id string, text string, impact string, blocking string, blocking_since string, asked_of string, based_on array<string>, raised array<struct<`to`:string,at:string,`where`:string>>,"
    " answered_by string, dropped_reason string, redactions array<string>, date string",
}
MAJOR = 1
LOG = "log"


class Conflict(RuntimeError):
    """Another writer changed the archive."""


class Store:
    """Tables of one archive under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Folder(spark, root)

    def create(self) -> None:
        """An empty archive with all its tables."""
        if self.version() is None:
            self.commit({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}, None)

    def version(self) -> str | None:
        """The number of the last entry of the log."""
        entries = [n for n in self.root.names(LOG) if n.endswith(".json")]
        return entries[-1].removesuffix(".json") if entries else None

    def _tables(self, version: str | None) -> dict[str, str]:
        return json.loads(self.root.read_text(f"{LOG}/{version}.json"))["tables"] if version else {}

    def read(self, name: str) -> DataFrame:
        """One table of the current snapshot; a table that the archive lacks is empty."""
        at = self._tables(self.version()).get(name)
        if at is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self.root.at(at))

    def commit(self, changed: dict[str, DataFrame], since: str | None) -> str:
        """A new snapshot with the changed tables; the others stay where they are. All or nothing."""
        tables, stage = self._tables(since), uuid.uuid4().hex
        for name, df in changed.items():
            tables[name] = f"{stage}/{name}"
            df.write.parquet(self.root.at(tables[name]))
        number = f"{int(since or 0) + 1:012}"
        entry = json.dumps({"tables": tables, "format": f"{MAJOR}.0"})
        if not self.root.write_new(f"{LOG}/{number}.json", entry, f"{LOG}/.{stage}"):
            raise Conflict("the archive has changed since")
        return number

    def export_json(self, path: str) -> None:
        """The whole archive as one JSON document per table, a row per line."""
        out = Folder(self.spark, path)
        for name in TABLES:
            self.read(name).write.mode("overwrite").json(out.at(name))

    def import_manifest(self, path: str) -> None:
        """Takes over a manifest: one JSON document with a section per table; missing sections are empty."""
        head = self.spark.read.text(path, wholetext=True).select(
            F.get_json_object("value", "$").isNotNull().alias("whole"), F.coalesce(F.get_json_object("value", "$.spec"), F.lit("1.0")).alias("spec")
        ).first()
        if head is None or not head.whole:
            raise ValueError("the manifest is no JSON document")
        if not head.spec.split(".")[0].isdigit() or int(head.spec.split(".")[0]) > MAJOR:
            raise ValueError(f"format {head.spec} is not known")
        sections = {n: f"array<struct<{_fields(s)}>>" for n, s in TABLES.items() if n not in ("export", "keys")}
        schema = ", ".join(f"{n}: {t}" for n, t in sections.items()) + f", export: struct<{_fields(TABLES['export'])}>"
        df = self.spark.read.schema(schema.replace(": ", " ")).option("multiLine", True).json(path)
        tables = {n: df.select(F.inline(F.coalesce(F.col(n), F.array().cast(t)))) for n, t in sections.items()}
        tables["export"] = df.where("export is not null").select("export.*")
        self.commit(tables, self.version())


def _fields(schema: str) -> str:
    return ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with new rows; columns that they lack are null."""
    return table.unionByName(rows.select([c for c in rows.columns if c in table.columns]), allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the values of ``changes`` (one row per key) where these are not null."""
    renamed = changes.select(*(F.col(c).alias(f"_new_{c}") for c in changes.columns))
    joined = table.join(renamed, F.col(key) == F.col(f"_new_{key}"), "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in table.columns))


def append_marks(table: DataFrame, marks: DataFrame) -> DataFrame:
    """``table`` whose ``raised`` grows by the marks (id, to, at, where), in order of ``at``."""
    grown = marks.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("at", "to", "where"))).alias("_m"))
    own = F.coalesce("raised", F.array().cast("array<struct<`to`:string,at:string,`where`:string>>"))
    more = F.transform(F.coalesce("_m", F.array().cast("array<struct<at:string,`to`:string,`where`:string>>")), lambda x: F.struct(x["to"].alias("to"), x["at"].alias("at"), x["where"].alias("where")))
    joined = table.join(grown, F.col("id") == F.col("_id"), "left").withColumn("raised", F.concat(own, more))
    return joined.select(*table.columns)


def retire(table: DataFrame, retired: DataFrame, gone: DataFrame, was: Column, on: str) -> tuple[DataFrame, DataFrame]:
    """(table, retired) after the records of gone (id, reason) are taken out; their ids are never used again."""
    out = table.join(gone.select("id", "reason"), "id")
    rows = out.select("id", was.alias("was"), F.col("reason"), F.lit(on).alias("date"))
    return table.join(gone.select("id"), "id", "left_anti"), retired.unionByName(rows)


def redact(table: DataFrame, redaction: str, ids: DataFrame) -> DataFrame:
    """``table`` whose records of ids (id) name the redaction once."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    joined = table.join(hit, F.col("id") == F.col("_hit"), "left")
    own = F.coalesce("redactions", F.array().cast("array<string>"))
    return joined.withColumn("redactions", F.when(F.col("_hit").isNotNull(), F.array_union(own, F.array(F.lit(redaction)))).otherwise(F.col("redactions"))).select(*table.columns)


def rehash(items: DataFrame, files: DataFrame, on: str) -> DataFrame:
    """``items`` whose file (path, sha256) has other contents now: the new fingerprint, and a note of the change."""
    now = files.select(F.col("path").alias("_p"), F.col("sha256").alias("_h"))
    joined = items.join(now, F.col("raw_path") == F.col("_p"), "left")
    other = F.col("_h").isNotNull() & ~F.col("_h").eqNullSafe(F.col("sha256"))
    note = F.concat_ws("; ", F.nullif(F.col("fidelity_note"), F.lit("")), F.concat(F.lit(f"{on}: fingerprint "), F.substring("_h", 1, 12)))
    joined = joined.withColumn("fidelity_note", F.when(other, note).otherwise(F.col("fidelity_note"))).withColumn("sha256", F.when(other, F.col("_h")).otherwise(F.col("sha256")))
    return joined.select(*items.columns)


def fulfil_gaps(items: DataFrame, files: DataFrame) -> DataFrame:
    """``items`` whose missing files (path, sha256) have come: present, with their fingerprint; all else as it was."""
    come = files.select(F.col("path").alias("_p"), F.col("sha256").alias("_h"))
    joined = items.join(come, (F.col("raw_path") == F.col("_p")) & (F.col("status") == "missing"), "left")
    joined = joined.withColumn("status", F.when(F.col("_p").isNotNull(), "present").otherwise(F.col("status"))).withColumn("sha256", F.coalesce("_h", "sha256"))
    return joined.select(*items.columns)

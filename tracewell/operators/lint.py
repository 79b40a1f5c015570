"""Integrity rules: each is a query, all together one table of violations (severity, code, message, place)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.keys import day, record_id
from tracewell.functions.text import contained_path, nonblank, version_parts
from tracewell.operators.ingest import ATTRIBUTION
from tracewell.operators.registry import account_clashes, alias_clashes, strangers

#: The closed domains of records.
SOURCES = ("telegram", "voice", "screenshot", "docx", "xlsx", "web", "claude-chat", "daily", "other")
FIDELITY = ("verbatim", "reconstructed", "digest", "placeholder")
STATUS = ("present", "missing", "unrecoverable")
CONTOURS = ("work", "personal", "public")
ROLES = ("self", "client", "colleague", "management", "other")
REASONS = ("pii", "off-topic", "leaked-internal", "client-confidential")
#: What an archive must have, and what may lie at its top.
REQUIRED = ("MANIFEST.json", "INDEX.md", "summaries/attachments-summary.md", "summaries/conventions.md", "summaries/findings-log.md", "summaries/redactions.md")
TOP = ("MANIFEST.json", "INDEX.md", "summaries", "raw")
#: The version of the format that a section, or a field, asks for.
SECTION_VERSIONS = {"imports": "1.1", "people": "1.2", "retired": "1.5", "requirements": "1.7", "questions": "1.7"}


def violation(rows: DataFrame, severity: str, code: str, message: Column | str, place: Column) -> DataFrame:
    text = message if isinstance(message, Column) else F.lit(message)
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("message"), place.alias("place"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(rows: DataFrame, key: Column) -> DataFrame:
    """(key, extra): keys that occur more than once, and how often too many."""
    return rows.groupBy(key.alias("key")).agg((F.count("*") - 1).alias("extra")).where("key is not null and extra > 0")


def v01_v02(items: DataFrame, files: DataFrame) -> DataFrame:
    """Present items need a path with a file (V01) of the same fingerprint (V02); files are (path, sha256)."""
    held = items.where("status = 'present'").select("id", "raw_path", "sha256")
    joined = held.join(files.select(F.col("path").alias("_p"), F.col("sha256").alias("_h")), F.col("raw_path") == F.col("_p"), "left")
    gone = violation(joined.where("_p is null"), "E", "V01", "no file", F.col("id"))
    other = violation(joined.where("_p is not null and not (sha256 <=> _h)"), "E", "V02", "other contents", F.col("id"))
    return gone.unionByName(other)


def untracked(items: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of files that no item names, neither as its file nor as one derived from it."""
    named = items.select(F.col("raw_path").alias("path")).unionByName(items.select(F.explode("derived_paths").alias("path"))).where("path is not null").distinct()
    return files.select("path").distinct().join(named, "path", "left_anti")


def v03(items: DataFrame, files: DataFrame) -> DataFrame:
    return violation(untracked(items, files), "E", "V03", "file that no item names", F.col("path"))


def v04(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (doc, target) without a file."""
    lost = links.join(files.select(F.col("path").alias("target")), "target", "left_anti")
    return violation(lost, "E", "V04", "link without target", F.concat(F.col("doc"), F.lit(" -> "), F.col("target")))


def v05(items: DataFrame) -> DataFrame:
    return violation(items.where((F.coalesce("fidelity", F.lit("")) != "verbatim") & ~nonblank(F.col("fidelity_note"))), "E", "V05", "fidelity without a note", F.col("id"))


def v06(items: DataFrame) -> DataFrame:
    lost = items.where((F.col("status") == "missing") & ~nonblank(F.col("raw_path")))
    held = items.where((F.col("status") == "unrecoverable") & F.col("raw_path").isNotNull())
    level = items.where((F.col("status") == "unrecoverable") & ~F.col("fidelity").eqNullSafe("placeholder"))
    return union([
        violation(lost, "E", "V06", "missing without expected path", F.col("id")),
        violation(held, "E", "V06", "unrecoverable with a path", F.col("id")),
        violation(level, "E", "V06", "unrecoverable but no placeholder", F.col("id")),
    ])


def v06_appeared(items: DataFrame, files: DataFrame) -> DataFrame:
    """Missing items whose file has come: a warning; files are (path)."""
    come = files.select(F.col("path").alias("raw_path")).distinct()
    return violation(items.where("status = 'missing'").join(come, "raw_path", "left_semi"), "W", "V06", "file has come", F.col("id"))


def v07(files: DataFrame) -> DataFrame:
    """What an archive must have and files (path) lack."""
    asked = files.sparkSession.createDataFrame([(x,) for x in REQUIRED], "path string")
    return violation(asked.join(files.select("path"), "path", "left_anti"), "E", "V07", "required file is not there", F.col("path"))


def v11(files: DataFrame) -> DataFrame:
    """Entries at the top of an archive that no rule allows; hidden ones don't count; files are (path)."""
    top = files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("top")).distinct()
    return violation(top.where(~F.col("top").isin(*TOP) & ~F.col("top").startswith(".")), "E", "V11", "outside the allowed zones", F.col("top"))


def v15(redactions: DataFrame) -> DataFrame:
    """Redactions (id, reason, description, reversible, vault_ref): unique id, a known reason, a description; what can be
    undone says where the original is, and never inside the archive."""
    inside = nonblank(F.col("vault_ref")) & contained_path(F.col("vault_ref")).isNotNull()
    return union([
        violation(repeated(redactions, F.col("id")), "E", "V15", "id repeated", F.col("key")),
        violation(redactions.where(~F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))), "E", "V15", "reason outside its domain", F.col("id")),
        violation(redactions.where(~nonblank(F.col("description"))), "E", "V15", "no description", F.col("id")),
        violation(redactions.where(F.coalesce("reversible", F.lit(False)) & (F.coalesce("vault_ref", F.lit("")) == "")), "E", "V15", "no place of the original", F.col("id")),
        violation(redactions.where(inside), "E", "V15", "original inside the archive", F.col("id")),
    ])


def report(violations: DataFrame, strict: bool = False) -> DataFrame:
    """(ok, errors, warnings, passes): no errors; how many of each; whether the run passes, in strict mode without warnings."""
    counts = violations.agg(F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"))
    ok = F.col("errors") == 0
    return counts.select(ok.alias("ok"), "errors", "warnings", (ok & (F.lit(not strict) | (F.col("warnings") == 0))).alias("passes"))


def v09(records: DataFrame, redactions: DataFrame) -> DataFrame:
    """Redactions of records (id, redactions) that are not in redactions (id)."""
    used = records.select("id", F.explode("redactions").alias("redaction"))
    lost = used.join(redactions.select(F.col("id").alias("redaction")), "redaction", "left_anti")
    return violation(lost, "E", "V09", F.concat(F.lit("unknown redaction "), F.col("redaction")), F.col("id"))


def v10(items: DataFrame, as_of: str) -> DataFrame:
    """Items: unique id, a day that exists and is not in the future, values of the closed domains."""
    same = repeated(items, F.col("id"))
    on = day(F.col("date"))
    wrong = items.where(on.isNull() | (on > F.lit(as_of).cast("date")))
    parts = [violation(same, "E", "V10", F.concat(F.lit("id repeated "), F.col("extra").cast("string")), F.col("key")), violation(wrong, "E", "V10", "no such day", F.col("id"))]
    for column, domain in (("source", SOURCES), ("fidelity", FIDELITY), ("status", STATUS), ("contour", CONTOURS)):
        bad = items.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))
        parts.append(violation(bad, "E", "V10", f"{column} outside its domain", F.col("id")))
    return union(parts)


def v13(items: DataFrame) -> DataFrame:
    """Authorship inside its domain; anything but reliable needs a note. Without a value it is reliable."""
    outside = items.where(F.col("attribution").isNotNull() & ~F.col("attribution").isin(*ATTRIBUTION))
    bare = items.where((F.coalesce("attribution", F.lit(ATTRIBUTION[0])) != ATTRIBUTION[0]) & ~nonblank(F.col("fidelity_note")))
    return violation(outside, "E", "V13", "attribution outside its domain", F.col("id")).unionByName(violation(bare, "E", "V13", "doubtful authorship without a note", F.col("id")))


def v14(items: DataFrame, requirements: DataFrame, people: DataFrame) -> DataFrame:
    """Names of participants and of those who asked that nobody in people has."""
    names = items.select(F.explode("participants").alias("name")).unionByName(requirements.select(F.col("wanted_by").alias("name")))
    return violation(strangers(names, people), "W", "V14", "nobody in people", F.col("name"))


def v16(people: DataFrame) -> DataFrame:
    same = repeated(people, F.col("id"))
    role = people.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)))
    selves = people.where("role = 'self'").agg(F.count("*").alias("n")).where("n > 1")
    return union([
        violation(same, "E", "V16", "id repeated", F.col("key")),
        violation(role, "E", "V16", "role outside its domain", F.col("id")),
        violation(people.where(~nonblank(F.col("display"))), "E", "V16", "no display name", F.col("id")),
        violation(selves, "E", "V16", "more than one self", F.col("n").cast("string")),
        violation(alias_clashes(people), "E", "V16", "name of several people", F.col("key")),
        violation(account_clashes(people), "E", "V16", "account of several people", F.concat_ws(":", "type", "account")),
    ])


def v17(items: DataFrame) -> DataFrame:
    """Items that name a file which an item with a smaller id names; an item that is repeated counts once."""
    named = items.where("raw_path <> ''").select("id", "raw_path").distinct()
    first = named.groupBy("raw_path").agg(F.min("id").alias("first")).withColumnRenamed("raw_path", "_p")
    later = named.join(first, F.col("raw_path") == F.col("_p")).where("id <> first")
    return violation(later, "E", "V17", F.concat(F.lit("file of "), F.col("first")), F.col("id"))


def required_version(sections: DataFrame) -> DataFrame:
    """(version): the least version of the format for sections (section, rows); only those with rows count."""
    asked = F.element_at(F.create_map(*(F.lit(x) for p in SECTION_VERSIONS.items() for x in p)), F.col("section"))
    parts = sections.where("rows > 0").select(version_parts(F.coalesce(asked, F.lit("1.0"))).alias("v"))
    return parts.agg(F.coalesce(F.array_join(F.max("v"), "."), F.lit("1.0")).alias("version"))


def v18(declared: DataFrame, sections: DataFrame) -> DataFrame:
    """The declared version (version) must not be below what the sections need."""
    both = declared.select("version", F.lit(1).alias("_j")).join(required_version(sections).select(F.col("version").alias("needed"), F.lit(1).alias("_j")), "_j")
    low = both.where(version_parts(F.col("version")) < version_parts(F.col("needed")))
    return violation(low, "E", "V18", F.concat(F.lit("needs "), F.col("needed")), F.col("version"))


def v19(requirements: DataFrame, cycles: DataFrame) -> DataFrame:
    """Requirements: unique id, a quote, an existing and different requirement they replace, no cycle (cycles: cycle)."""
    own, target = record_id(F.col("id")), record_id(F.col("supersedes"))
    rows = requirements.select(own.alias("id"), "quote", target.alias("target")).where("id is not null")
    known = rows.select(F.col("id").alias("target")).distinct()
    lost = rows.where("target is not null").join(known, "target", "left_anti")
    return union([
        violation(repeated(rows, F.col("id")), "E", "V19", "id repeated", F.col("key")),
        violation(rows.where(~nonblank(F.col("quote"))).select("id").distinct(), "E", "V19", "no quote", F.col("id")),
        violation(lost.select("id", "target").distinct(), "E", "V19", F.concat(F.lit("replaces unknown "), F.col("target")), F.col("id")),
        violation(rows.where("target = id").select("id").distinct(), "E", "V19", "replaces itself", F.col("id")),
        violation(cycles, "E", "V19", "cycle", F.col("cycle")),
    ])

"""What people read: index, redaction list, file names, notes, replies, the read contract, the public slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import cut_at_word, escape_cell, escape_markdown, nonblank, truthy
from tracewell.operators.archive import chronology, gaps, histogram, held, once, public, redaction_uses, slim, visible, zone_of, zones
from tracewell.operators.lint import FIDELITY
from tracewell.store import Store

CONTRACT = "2"


def message_file(day: Column, chat: Column, title: Column) -> Column:
    """File name of a day's transcript: day, chat and, if there is one, the title's slug."""
    return F.concat(day, F.lit("_"), chat, F.when(nonblank(title), F.concat(F.lit("_"), title)).otherwise(F.lit("")), F.lit(".md"))


def media_note(attribution: Column, shown_as: Column, via: Column) -> Column:
    """Why the author of a file is doubtful; null where it is not."""
    shown = F.when(truthy(shown_as), F.concat(F.lit("; shown as "), shown_as)).otherwise(F.lit(""))
    passed = F.when(truthy(via), F.concat(F.lit("; passed on by "), via)).otherwise(F.lit(""))
    return F.when(F.coalesce(attribution, F.lit("reliable")) == "reliable", F.lit(None)).otherwise(F.concat(F.lit("authorship "), attribution, shown, passed))


def reply_lines(name: Column, confirmed: Column, quote: Column, body: Column, number: Column, in_day: Column) -> Column:
    """Markdown above a reply: whom it answers, then what.

    A quote is given word for word and wins over the parent's text, which is given only if the parent is not on the
    same page.
    """
    who = F.when(truthy(name), F.concat(name, F.when(~confirmed, F.lit(" (not confirmed)")).otherwise(F.lit("")))).otherwise(F.lit("—"))
    head = F.concat(F.lit("> in reply to "), who, F.when(truthy(number), F.concat(F.lit(" #"), number)).otherwise(F.lit("")))
    quoted = lambda t: F.concat(F.lit("\n> "), F.replace(escape_markdown(t), F.lit("\n"), F.lit("\n> ")))
    more = F.when(truthy(quote), quoted(quote)).when(truthy(body) & ~F.coalesce(in_day, F.lit(False)), quoted(body)).otherwise(F.lit(""))
    return F.concat(head, more)


def index_lines(items: DataFrame, requirements: DataFrame, people: DataFrame) -> DataFrame:
    """(section, rank, line): the index of an archive, sections by number, lines in order.

    The lines stay a table, whatever their number; a sink writes them in the order of (section, rank).
    """
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *(escape_cell(F.coalesce(c, F.lit("—"))) for c in cells)), F.lit(" |"))
    n = lambda df, label: df.select(F.count("*").alias("n")).select(F.lit(1).alias("section"), F.lit(label).alias("_l"), "n")
    heads = n(items.select("id").distinct(), "items").unionByName(n(requirements.select("id").distinct(), "requirements")).unionByName(n(people.select("id").distinct(), "people"))
    heads = heads.select("section", F.when(F.col("_l") == "items", 1).when(F.col("_l") == "requirements", 2).otherwise(3).cast("long").alias("rank"), F.concat("_l", F.lit(": "), F.col("n").cast("string")).alias("line"))
    levels = histogram(items, "fidelity", FIDELITY, FIDELITY[-1]).select(F.lit(2).alias("section"), F.col("rank").cast("long").alias("rank"), row(F.col("level"), F.col("items").cast("string")).alias("line"))
    dated = chronology(items)
    facts = items.groupBy(F.col("id").alias("_id")).agg(F.min("source").alias("source"), F.min("fidelity").alias("fidelity"), F.min(zone_of(F.col("raw_path"))).alias("zone"))
    order = dated.join(facts, F.col("id") == F.col("_id")).select(F.lit(3).alias("section"), "rank", row(F.nullif("date", F.lit("")), F.col("id"), F.col("source"), F.col("fidelity"), F.col("zone")).alias("line"))
    lost = gaps(items).join(dated.select(F.col("id").alias("_id"), "rank"), F.col("id") == F.col("_id")).select(F.lit(4).alias("section"), "rank", row(F.col("id"), F.col("status"), F.col("raw_path")).alias("line"))
    return heads.unionByName(levels).unionByName(order).unionByName(lost)


def redaction_lines(items: DataFrame) -> DataFrame:
    """(redaction, line): redactions with the items they touch."""
    used = redaction_uses(items)
    return used.select("redaction", F.concat(F.lit("| "), escape_cell(F.col("redaction")), F.lit(" | "), F.col("items").cast("string"), F.lit(" |")).alias("line"))


def contract_lines(requirements: DataFrame, ranks: DataFrame, masked: bool = False) -> DataFrame:
    """(rank, json): requirements as the read contract gives them, in its order, one object per line."""
    needed = ("quote", "wanted_by", "based_on", "blocking", "stage", "supersedes", "note", "redactions", "date")
    placed = ranks.select(F.col("id").alias("_id"), "days_blocked", "rank")
    rows = once(requirements, *needed).join(placed, F.col("id") == F.col("_id"))
    quote = visible(F.col("quote"), F.col("redactions")) if masked else F.col("quote")
    fields = F.struct("id", quote.alias("quote"), "wanted_by", "based_on", "blocking", "days_blocked", "stage", "supersedes", "note", "redactions", "date")
    return rows.select("rank", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def short_quotes(requirements: DataFrame, limit: int = 80) -> DataFrame:
    """(id, line): quotes as a report lists them, masked and cut."""
    return requirements.select("id", cut_at_word(visible(F.col("quote"), F.col("redactions")), limit).alias("line"))


def publish(store: Store, target: Store) -> tuple[str, int]:
    """A new archive with the public items only, without people, redactions or journal: (snapshot, items held back)."""
    target.create()
    items = store.read("items")
    export = store.read("export").withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" (public)"))).withColumn("contour", F.lit("public")).withColumn("participants", F.array().cast("array<string>"))
    shown = public(items).withColumn("participants", F.array().cast("array<string>"))
    return target.commit({"items": shown, "export": export}, target.version()), held(items).count()


def guard(violations: DataFrame) -> None:
    """Refuses to go on if a rule that is an error is broken; names some of the places."""
    some = violations.where("severity = 'E'").limit(10).collect()
    if some:
        raise ValueError("; ".join(f"{r.code} {r.message}: {r.place}" for r in some))


__all__ = ["contract_lines", "guard", "index_lines", "media_note", "message_file", "publish", "redaction_lines", "reply_lines", "short_quotes", "slim", "zones"]

"""General problems: deduplication, timestamps, hierarchies, orphans, ranking."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions.keys import message_number, record_id
from tracewell.functions.zones import transitions, utc_to_local
from tracewell.operators import dedup, hierarchy, orphans, ranking
from tracewell.operators.timestamps import _known, message_instants, to_instants

MESSAGES = "row_id long, chat_slug string, msg_id string, reply_to string, date string, author string, text string, received_at timestamp_ntz, _n string, __extra int, n int"
T0 = datetime(2024, 1, 1)


def messages(spark, rows):
    """Rows (row_id, chat, msg_id, reply_to, date, author, text, seconds), with columns nobody asked for."""
    return spark.createDataFrame([(*r[:7], None if r[7] is None else T0 + timedelta(seconds=r[7]), "x", 1, 2) for r in rows], MESSAGES)


def ids(df, column="row_id"):
    return sorted(r[column] for r in df.select(column).collect())


# --- deduplication
def test_spellings_of_numbers(spark):
    cases = {"12": 12, " 0012 ": 12, "12.0": 12, "slug:12": 12, "SLUG: 12": 12, "a-b:0012\n": 12, "\xa012": 12, "": None, "x": None, None: None, "12.5": None, "1" * 19: int("1" * 19), "9" * 19: None, "0" * 40 + "7": 7, "1" * 20: None, "9" * 18: int("9" * 18)}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", message_number(F.col("x")).alias("n"))
    assert {r.x: r.n for r in df.collect()} == cases


def test_one_row_of_each_message_stays(spark):
    rows = [
        (1, "a", "5", None, None, None, None, 10), (2, "a", "a:05", None, None, None, None, 5), (3, "a", " 5.0", None, None, None, None, 5),
        (4, "b", "5", None, None, None, None, 1), (5, "a", None, None, None, None, None, 0), (6, "a", "no", None, None, None, None, 0),
        (7, None, "5", None, None, None, None, 1), (8, None, "5", None, None, None, None, None),
    ]
    df = messages(spark, rows)
    assert ids(dedup.redundant_rows(df)) == [1, 3, 8]
    assert ids(dedup.deduplicate(df)) == [2, 4, 5, 6, 7]
    assert dedup.deduplicate(df).columns == df.columns
    assert {(r.chat_slug, r.msg_no) for r in dedup.kept_rows(df).collect()} == {("a", 5), ("b", 5), (None, 5)}


def test_deduplication_of_nothing(spark):
    df = messages(spark, [])
    assert dedup.redundant_rows(df).count() == 0 and dedup.deduplicate(df).count() == 0


def test_permutation_is_reversible(spark):
    numbers = [0, 1, 2, 2**31, 2**32 - 1, 2**32, 2**62, 10**17] + [random.Random(1).randrange(2**63) for _ in range(500)]
    df = spark.createDataFrame([(n, f"c{n % 3}") for n in numbers], "n long, k string").withColumn("p", dedup.permute(F.col("n"), F.col("k")))
    rows = df.withColumn("back", dedup.unpermute(F.col("p"), F.col("k"))).collect()
    assert all(r.n == r.back for r in rows)
    assert len({(r.k, r.p) for r in rows}) == len({(r.k, r.n) for r in rows})
    keyed = dedup.quotient_keys(df, "k", "n").select("k", "quotient", "remainder").distinct().count()
    assert keyed == len({(r.k, r.n) for r in rows})


def test_hot_message(spark):
    """A third of all rows is one message."""
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.lit("a").alias("chat_slug"), F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") + 100).cast("string")).alias("msg_id"), F.lit(None).cast("timestamp_ntz").alias("received_at"))
    assert dedup.redundant_rows(df).count() == 999


# --- timestamps
UTC = timezone.utc


def us(text, tz="Europe/Berlin"):
    return to_instants(pa.array([text]), pa.array([tz])).to_pylist()[0]


def at(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-05T10:00:00", at(2024, 1, 5, 9)), ("2024-01-05T10:00:00Z", at(2024, 1, 5, 10)), ("2024-01-05T10:00:00.5+03:00", at(2024, 1, 5, 7, 0, 0, 500000)),
        ("1704448800", at(2024, 1, 5, 10)), ("1704448800123", at(2024, 1, 5, 10, 0, 0, 123000)), ("1704448800123456", at(2024, 1, 5, 10, 0, 0, 123456)),
        ("05.01.2024 10:00", at(2024, 1, 5, 9)), ("05/01/2024 10:00", at(2024, 1, 5, 9)), ("04/25/2024 10:00", at(2024, 4, 25, 8)), ("05.01.24, 10:00", at(2024, 1, 5, 9)),
        ("5 января 2024, 10:00", at(2024, 1, 5, 9)), ("5. Januar 2024 10:00", at(2024, 1, 5, 9)), ("January 5, 2024 12:30 AM", at(2024, 1, 4, 23, 30)), ("Jan 5, 2024 12:30 PM", at(2024, 1, 5, 11, 30)),
        ("Fri, 05 Jan 2024 10:00:00 +0530", at(2024, 1, 5, 4, 30)), ("2024-01-05 10:00:00 MSK", at(2024, 1, 5, 7)), ("2024-01-05 10:00:00 UTC+5:30", at(2024, 1, 5, 4, 30)), ("2024-01-05 10:00:00 GMT-6", at(2024, 1, 5, 16)),
        ("2024-01-05 10:00:00 America/New_York", at(2024, 1, 5, 15)), ("2024-01-05T10:00:00[America/New_York]", at(2024, 1, 5, 15)), ("2024-01-05T10:00:00+01:00[Europe/Berlin]", at(2024, 1, 5, 9)),
        ("20240105T100000Z", at(2024, 1, 5, 10)), ("2024-01-05", at(2024, 1, 4, 23)), ("2023-10-29 02:30:00", at(2023, 10, 29, 0, 30)), ("2024-03-31 02:30:00", at(2024, 3, 31, 1, 30)), ("2024-01-05T24:00:00Z", at(2024, 1, 6)),
        (" 2024-01-05 ", at(2024, 1, 4, 23)), ("2024-02-29", at(2024, 2, 28, 23)),
        ("Wednesday, 15. September 2021 10:15:30.123456 America/Argentina/Buenos_Aires", at(2021, 9, 15, 13, 15, 30, 123456)),
        ("2150-07-01 10:00", at(2150, 7, 1, 8)), ("2150-01-01 10:00", at(2150, 1, 1, 9)), ("9000-07-01 10:00", at(9000, 7, 1, 8)), ("1890-01-01 00:53:28", at(1890, 1, 1)),
    ],
)
def test_instants(text, expected):
    assert us(text) == expected


@pytest.mark.parametrize("text", [None, "", " ", "yesterday 9:15", "вчера, 14:20", "n/a", "00.00.0000 00:00", "31.06.2024 08:15", "2023-02-29", "2024-13-05 11:00:00", "2024-05-12T25:61:00", "2024-05", "14:20", "2024-01-05 10:00:00 XYZ", "2024-01-05 10:00:00 Mars/Base", "January 5, 2024 13:00 PM", "x" * 10_000])
def test_no_instants(text):
    assert us(text) is None


def test_without_zone():
    assert us("2024-01-05 10:00", None) is None and us("2024-01-05 10:00", "No/Where") is None
    assert us("2024-01-05 10:00Z", None) == at(2024, 1, 5, 10)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1850, 1, 1), datetime(7000, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/Moscow"]))
def test_zone_tables_agree_with_the_library(local, name):
    local = local.replace(microsecond=0)
    instant = us(local.isoformat(), name)
    assert instant == round((local - datetime(1970, 1, 1) - local.replace(tzinfo=ZoneInfo(name), fold=0).utcoffset()).total_seconds()) * 1_000_000
    shown = datetime(1970, 1, 1) + timedelta(seconds=utc_to_local(np.array([instant // 1_000_000]), name).tolist()[0])
    assert shown == (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=instant)).astimezone(ZoneInfo(name)).replace(tzinfo=None)


def test_each_shape_is_parsed_once():
    _known.cache_clear()
    texts = [f"2024-01-{i % 28 + 1:02d}T10:00:00" for i in range(500)]
    to_instants(pa.array(texts), pa.array(["UTC"] * 500))
    assert _known.cache_info().misses == 1 and transitions("UTC")[2].tolist() == [0]


def test_message_instants(spark):
    chats = spark.createDataFrame([("a", "Europe/Moscow"), ("a", "Europe/Moscow")], "chat_slug string, tz_name string")
    df = messages(spark, [(1, "a", None, None, "2024-01-05 10:00", None, None, 1), (2, "zz", None, None, "2024-01-05 10:00", None, None, 1), (3, "zz", None, None, "1704448800", None, None, 1)])
    assert {r.row_id: r.utc_us for r in message_instants(df, chats).collect()} == {1: at(2024, 1, 5, 7), 2: None, 3: at(2024, 1, 5, 10)}
    assert message_instants(messages(spark, []), chats.limit(0)).count() == 0


# --- hierarchies
def brute_tree(parent):
    out = {}
    for x in parent:
        seen, y = [], x
        while parent.get(y) is not None and y not in seen:
            seen.append(y)
            y = parent[y]
        if parent.get(y) is None:
            out[x] = (y, len(seen))
        else:
            cycle, z = [y], parent[y]
            while z != y:
                cycle.append(z)
                z = parent[z]
            out[x] = (min(cycle), -1)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"t{i:03d}" for i in range(120)]
    links = {n: r.choice([None, *names[:i]]) if r.random() < 0.85 else None for i, n in enumerate(names)}
    links["t000"], links["t005"], links["t009"] = None, "t009", "t005"
    links["t011"] = "t011"
    for i in range(60, 90):
        links[names[i]] = names[i - 1]  # one long line
    rows = [(n, p, 1) for n, p in links.items()] + [("t003", links["t003"], 2), (None, "t001", 0), ("t119x", " gone ", 0)]
    df = spark.createDataFrame(rows, "id string, up string, root int")
    tree = hierarchy.hierarchy(hierarchy.links(df, record_id(F.col("id")), record_id(F.col("up"))))
    got = {r.id: r for r in tree.collect()}
    expected = brute_tree({**links, "t119x": None})
    assert {k: (v.root, v.depth) for k, v in got.items()} == expected
    path = {r.id: r.path for r in hierarchy.paths(tree).collect()}
    inside = {(a, b) for a in got for b in got if got[a].entry and got[b].entry and got[a].root == got[b].root and got[a].entry < got[b].entry and got[b].exit < got[a].exit}
    pairs = {(r.ancestor, r.descendant): r.distance for r in hierarchy.descendants(hierarchy.paths(tree)).collect()}
    assert set(pairs) == inside
    for k, (root, depth) in expected.items():
        if depth >= 0:
            assert path[k][0] == root and path[k][-1] == k and len(path[k]) == depth + 1
            assert got[k].descendants == sum(1 for a, _ in inside if a == k)
        else:
            assert k not in path


def test_hierarchy_of_nothing(spark):
    nodes = hierarchy.links(spark.createDataFrame([], "id string, up string"), F.col("id"), F.col("up"))
    assert hierarchy.hierarchy(nodes).count() == 0


def test_many_children(spark):
    """One parent with nearly all rows as children."""
    df = spark.range(1, 1500).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("top").alias("up")).unionByName(spark.createDataFrame([("top", None)], "id string, up string"))
    tree = hierarchy.hierarchy(hierarchy.links(df, F.col("id"), F.col("up")))
    assert tree.where("root = 'top'").count() == 1500 and tree.where("id = 'top'").first().descendants == 1499


def test_climb(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7), (9, 7)], "id long, parent long")
    ended, endless = hierarchy.climb(edges)
    assert {(r.id, r.root, r.level) for r in ended.collect()} == {(1, 4, 3), (2, 4, 2), (3, 4, 1)}
    assert ids(endless, "id") == [7, 8, 9]


# --- orphans
def test_orphans(spark):
    items = spark.createDataFrame([("i1", "2024-01-05"), ("i1", "2024-01-05"), ("i2", "2024-1-9"), ("i3", "2024-99-01"), (None, None)], "id string, imported string")
    reqs = spark.createDataFrame(
        [("t1", [" I1 ", "i9", "i8", "", "ctx:a#i001", None], "t2", "2024-01-06"), ("t1", [" I1 ", "i9", "i8", "", "ctx:a#i001", None], "t2", "2024-01-06"), ("t2", ["i2", "i3"], "t7", "2024-01-07"), ("t3", None, " ", None), ("t4", ["i2"], "t1", "")],
        "id string, based_on array<string>, supersedes string, date string",
    )
    retired = spark.createDataFrame([("i8",), ("t7",), ("x1",)], "id string")
    chat = messages(spark, [(1, "a", "1", None, None, None, None, 50), (2, "a", "2", "a:01", None, None, None, 20), (3, "a", "3", "99", None, None, None, 1), (4, "a", "3", "1", None, None, None, 2), (5, "b", "4", "1", None, None, None, 1), (6, "a", "5", "1", None, None, None, 60)])
    found = {(r.ref_field, r.from_key, r.to_key, r.cause) for r in orphans.orphans(items, reqs, retired, chat).collect()}
    assert found == {
        ("based_on", "t1", "i9", "missing"), ("based_on", "t1", "i8", "deleted"), ("based_on", "t2", "i2", "late"), ("supersedes", "t1", "t2", "late"), ("supersedes", "t2", "t7", "deleted"),
        ("reply_to", "a:2", "a:1", "late"), ("reply_to", "a:3", "a:99", "missing"), ("reply_to", "b:4", "b:1", "missing"),
    }
    report = orphans.orphan_report(orphans.orphans(items, reqs, retired, chat)).collect()
    assert sum(r.orphans for r in report) == len(found) and ("based_on", "2024-01", "late", 1) in {tuple(r) for r in report}


def test_orphans_of_nothing(spark):
    none = orphans.orphans(
        spark.createDataFrame([], "id string, imported string"), spark.createDataFrame([], "id string, based_on array<string>, supersedes string, date string"), spark.createDataFrame([], "id string"), messages(spark, [])
    )
    assert none.count() == 0


# --- ranking
def test_positions(spark):
    rows = [(i % 3 if i % 5 else None, i // 7, i, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, i int, _part string")
    got = {r.i: r.position for r in ranking.positions(df, ["g"], ["o", "i"]).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            expected[r[2]] = n
    assert got == expected

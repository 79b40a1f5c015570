"""The archive's own operators: functions, intake, registry, rules, sources, store, streaming."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.keys import day
from tracewell.operators import archive, ingest, lint, registry
from tracewell.operators.timestamps import message_days
from tracewell.sources import chats, files
from tracewell.store import TABLES, Conflict, Store, append_marks, fulfil_gaps, insert, redact, retire, update
from tracewell.streaming.incremental import Intake

ROW = "row_id long, batch_id long, source_id string, chat_slug string, msg_id string, date string, author string, text string, via string, media string, media_kind string, attribution string, key string"


def rows(spark, data):
    """(row_id, source, msg_id, date, author, text, media); other columns are empty or made up."""
    return spark.createDataFrame([(i, 1, s, "a", m, d, a, t, None, f, "photo" if f else None, None, "zz") for i, s, m, d, a, t, f in data], ROW)


def values(spark, cases, f, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_functions(spark):
    assert values(spark, [" a \n\tb\xa0 c ", "", None, "\u2003x\x85"], X.collapse) == ["a b c", "", None, "x"]
    assert values(spark, [" Ann-Marie  O'Neil! ", "ЮЛЯ 🌿", None], X.name_key) == ["ann-marie oneil", "юля", None]
    assert values(spark, ["short", "one two three four", "x" * 30], lambda c: X.cut_at_word(c, 12)) == ["short", "one two…", "x" * 12 + "…"]
    assert values(spark, ["# a\n- b & <c>\n1. d\n```"], X.escape_markdown) == ["\\# a\n\\- b &amp; &lt;c&gt;\n\\1. d\n\\```"]
    assert values(spark, ["a|b\nc"], X.escape_cell) == ["a\\|b c"]
    assert values(spark, ["a  `b`"], X.inline_span) == ["a 'b'"]
    assert values(spark, ["raw/a b+c/ü~*.md"], X.url_path) == ["raw/a%20b%2Bc/%C3%BC~%2A.md"]
    assert values(spark, ["a%20b+c%2B"], X.url_unpath) == ["a b+c+"]
    assert values(spark, ["ctx:a-b#i001", "ctx:a#i01", "i001", None], X.context_reference) == [True, False, False, False]
    assert values(spark, ["1.10", "x", "2"], X.version_parts) == [[1, 10], [0], [2]]
    assert values(spark, [["a", " a", "", None, "b"], None], X.distinct_list, "array<string>") == [["a", "b"], []]
    assert values(spark, ["a/../b.md", "../x", "/abs", "", None, "a/./b", "C:\\x", ".."], X.contained_path) == ["b.md", None, None, None, None, "a/b", None, None]
    assert values(spark, ["Привет, Мир!", "Ünï cödé", "***", "a" * 80, None], X.slugify) == ["privet-mir", "uni-code", "unnamed", "a" * 60, None]
    assert values(spark, ['"plain"', '["a", {"type": "b", "text": "c"}, {"type": "d"}]', None, "[]"], X.rich_text) == ["plain", "ac", "", ""]
    assert [str(x) for x in values(spark, ["2024-2-3", "2024-02-30", "", None, " 2024-02-03 ", "2024-02"], day)] == ["2024-02-03", "None", "None", "None", "2024-02-03", "None"]


def test_overlap(spark):
    df = spark.createDataFrame([("Please review the drafts", "review draft now please"), ("", "x"), (None, "abc def")], "a string, b string")
    assert [r[0] for r in df.select(X.overlap(X.stems(F.col("a")), X.stems(F.col("b")))).collect()] == [3 / 4, 0.0, 0.0]
    assert df.limit(1).select(X.character_ratio(F.col("a"), F.col("a"))).first()[0] == 1.0


def test_incremental_import_is_idempotent(spark):
    first = rows(spark, [(1, "s", "1", "2024-01-01T10:00", "A", "hello there, all", None), (2, "s", "1", "2024-01-01T10:00", "A", "again", None), (3, None, None, "2024-01-01T10:00", "B", "ok", None)])
    known = ingest.known_keys(first)
    assert ingest.new_messages(first, known, "row_id").count() == 0
    empty = spark.createDataFrame([], "key string")
    assert sorted(r.row_id for r in ingest.new_messages(first, empty, "row_id").collect()) == [1, 3]
    other = rows(spark, [(7, "t", "9", "2024-01-01T10:00:30", "C", " hello  there, all", None), (8, "t", "10", "2024-01-01T10:01", "C", "hello there, all", None), (9, "t", "10", "2024-01-01T10:02", "C", "later", None)])
    assert [r.row_id for r in ingest.new_messages(other, known, "row_id").collect()] == [8]


def test_content_key(spark):
    df = rows(spark, [(1, "s", "1", "2024-01-01T10:00:01", "A", "x" * 11, None), (2, "s", "1", "2024-01-01T10:00:59", "A", "x" * 12, None), (3, "s", "2", "2024-01-01T10:00", "B", "x" * 12, "f"), (4, None, None, None, None, None, None), (5, "q", "8", "2024-01-01T10:00", "Z", "x" * 12, None)])
    got = {r.row_id: (r.key, r.ckey) for r in ingest.with_keys(df).collect()}
    assert got[1][1] is None and got[3][1] is None and got[4][1] is None and got[2][1] == got[5][1] and got[2][0] == "s:1" and got[4][0].startswith("txt:")


def test_days(spark):
    """Days are those of the chat's clock, in whatever form the date is written; undated rows are a day of their own."""
    df = rows(spark, [(1, "s", "1", "1 January 2024 23:30 UTC", "B", "x", None), (2, "s", "2", "1704150000", "A", None, "d/f.png"), (3, "s", "3", "bad", "C", "x", None), (4, "s", "4", None, None, None, None)])
    chats_ = spark.createDataFrame([("a", "Europe/Berlin", "Plan"), ("b", "UTC", "x")], "chat_slug string, tz_name string, title string")
    df = df.withColumn("attribution", F.when(F.col("row_id") == 2, "forwarder-shown")).withColumn("reply_context", F.when(F.col("row_id") == 2, '{"kind": "message", "message_id": "1", "author_name": "B", "text": "x"}')).withColumns({"note": F.lit(None).cast("string"), "shown_as": F.lit(None).cast("string")})
    df = message_days(df, chats_)
    assert {r.row_id: (r.day, r.clock) for r in df.collect()} == {1: ("2024-01-02", "00:30"), 2: ("2024-01-02", "00:00"), 3: (None, None), 4: (None, None)}
    day_ = sorted((tuple(r) for r in ingest.days(df).collect()), key=str)
    assert day_ == [("a", "2024-01-02", 2, "forwarder-shown", True, "A; B"), ("a", None, 2, "reliable", False, "C")]
    assert [tuple(r) for r in ingest.demotions(df).collect()] == [("a", "2024-01-02", "A")]
    files_ = spark.createDataFrame([("d/f.png", "raw/f.png")], "media string, path string")
    text = {r.day: r for r in ingest.transcript(df, files_, chats_).collect()}
    assert text["2024-01-02"].messages == 2 and text[None].messages == 2
    assert text["2024-01-02"].text.startswith("# Plan — 2024-01-02\n\n> Authorship: forwarder-shown\n\n> ⚠") and text[None].text.startswith("# Plan — undated")
    assert text["2024-01-02"].text.endswith("### 00:00 · ⚠ A\n> in reply to B #1\n\n🖼 picture: [`f.png`](../../raw/f.png)\n\n### 00:30 · B\n\nx")
    none = message_days(rows(spark, []).withColumns({"reply_context": F.lit(""), "note": F.lit(""), "shown_as": F.lit("")}), chats_.limit(0))
    assert ingest.days(none).count() == 0 and ingest.transcript(none, files_.limit(0), chats_.limit(0)).count() == 0


@pytest.mark.parametrize(
    "kind, origin, name, author, expected",
    [
        ("message", None, None, "Ann", ("Ann", True)), ("message", "user", "Bob", "Ann", ("Bob", True)), ("message", "hidden_user", "Shown", "Ann", ("Shown", False)), ("message", None, None, None, (None, False)),
        ("external", "user", "Bob", None, ("Bob", True)), ("external", "hidden_user", "Shown", None, ("Shown", False)), ("quote", None, None, "Ann", (None, False)), (None, None, None, None, (None, False)),
    ],
)
def test_reply_authorship(spark, kind, origin, name, author, expected):
    df = spark.createDataFrame([(kind, origin, name, author)], "k string, o string, n string, a string")
    got = df.select(ingest.reply_authorship(F.col("k"), F.col("o"), F.col("n"), F.col("a")).alias("w")).first().w
    assert (got.name, got.confirmed) == expected


def test_free_names(spark):
    wanted = spark.createDataFrame([("a.md", 1), ("a.md", 2), ("a.md", 3), ("b", 4)], "path string, row_id long")
    taken = spark.createDataFrame([("a.md",), ("a-3.md",), ("c.md",)], "path string")
    assert {r.row_id: r.name for r in ingest.free_names(wanted, taken).collect()} == {1: "a-2.md", 2: "a-4.md", 3: "a-5.md", 4: "b"}


def people(spark, data):
    return spark.createDataFrame(data, "id string, display string, role string, aliases array<string>, handles map<string,string>, note string")


def test_registry(spark):
    df = people(spark, [("p1", "Ann Lee", "client", ["Annie"], {"mail": "a@x.test"}, None), ("p2", "Bob", "self", None, None, None), ("p3", "annie", "x", [""], {"mail": "A@x.test"}, None), ("p4", None, None, None, {"mail": " "}, None)])
    names = spark.createDataFrame([("ANN LEE!",), ("annie",), ("Nobody",), ("",), (None,), ("a@x.test",)], "name string")
    assert {r.name: r.id for r in registry.resolve(names, df).collect()} == {"ANN LEE!": "p1", "annie": "p1", "Nobody": None, "": None, "a@x.test": "p1"}
    assert [r.name for r in registry.strangers(names, df).collect()] == ["Nobody"]
    assert [tuple(r) for r in registry.alias_clashes(df).collect()] == [("annie", 2, "p1")]
    assert [tuple(r) for r in registry.account_clashes(df).collect()] == [("mail", "a@x.test", 2, "p1")]
    codes = sorted((r.message, r.place) for r in lint.v16(df).collect())
    assert codes == [("account of several people", "mail:a@x.test"), ("name of several people", "annie"), ("no display name", "p4"), ("role outside its domain", "p3"), ("role outside its domain", "p4")]


ITEM = TABLES["items"]


def item(**k):
    base = dict(id="i1", source="other", origin=None, fidelity="verbatim", fidelity_note=None, date="2024-01-01", imported="2024-01-02", participants=[], raw_path="raw/x/a.md", sha256="h", derived_paths=[], attribution=None, status="present", summary_ref=None, redactions=[], tags=[], project=None, contour="work")
    return tuple((base | k).values())


def test_rules_fire_alone(spark):
    ok = spark.createDataFrame([item()], ITEM)
    tree = spark.createDataFrame([("raw/x/a.md", "h")], "path string, sha256 string")
    rules = {"V05": lint.v05, "V06": lint.v06, "V10": lambda d: lint.v10(d, "2024-06-01"), "V13": lint.v13, "V17": lint.v17, "V01": lambda d: lint.v01_v02(d, tree), "V03": lambda d: lint.v03(d, tree)}
    assert all(f(ok).count() == 0 for f in rules.values())
    broken = {
        "V05": [item(fidelity="digest")], "V06": [item(status="missing", raw_path=" ")], "V10": [item(date="2025-01-01")], "V13": [item(attribution="unknown")],
        "V17": [item(), item(id="i2")], "V01": [item(raw_path="raw/none.md")], "V03": [item(raw_path=None)],
    }
    for code, data in broken.items():
        assert rules[code](spark.createDataFrame(data, ITEM)).count() == 1, code
    assert lint.v01_v02(spark.createDataFrame([item(sha256="other")], ITEM), tree).first().code == "V02"
    assert all(f(spark.createDataFrame([], ITEM)).count() == 0 for n, f in rules.items() if n != "V03")
    sections = spark.createDataFrame([("people", 3), ("requirements", 0)], "section string, rows long")
    assert lint.required_version(sections).first().version == "1.2"
    assert lint.v18(spark.createDataFrame([("1.1",)], "version string"), sections).count() == 1


def test_similar_texts_against_brute_force(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf"]
    data = [(f"t{i:03d}", " ".join(words[(i * k) % 7] for k in range(1, 2 + i % 5))) for i in range(60)] + [("t900", None), ("t901", ""), ("t902", "alpha bravo")]
    df = spark.createDataFrame(data, "id string, text string")
    got = {(r.query, r.id) for r in archive.similar_texts(df, df).collect()}
    first = {}
    for i, t in sorted(data):
        if t:
            first.setdefault(t, i)
    sets = {i: {w[:5] for w in t.split()} for t, i in first.items()}
    assert got == {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.62}


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office(spark):
    w, s = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    docx = office({"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p/><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:document>", "word/media/b.png": "x"})
    xlsx = office({"xl/sharedStrings.xml": f"<sst {s}><si><t>A</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c t="s"><v>9</v></c></row></worksheet>'})
    df = spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.pdf", b"x"), ("d.docx", b"no zip"), ("e.bin", b""), ("f.docx", office({"x": "y"}))], "path string, content binary")
    got = {r.path: (r.text, r.images, r.problem) for r in files.extract(df).collect()}
    assert got == {"a.docx": ("One two\n\nthree", 1, None), "b.xlsx": ("# sheet1\nA\t5", 0, None), "c.pdf": (None, 0, "known but unreadable"), "d.docx": (None, 0, "broken"), "e.bin": (None, 0, "unknown kind"), "f.docx": ("", 0, None)}


def test_sources(spark, tmp_path):
    export = {"name": "N", "id": 7, "messages": [{"id": 1, "type": "service"}, {"id": 2, "type": "message", "date": "2024-01-01T10:00:00", "from": "Ann", "text": ["a", {"type": "b", "text": "c"}], "photo": "p.jpg"}, {"id": 3, "type": "message", "date": "2024-01-01T10:01:00", "actor": "Bob", "forwarded_from": "Cy", "text": "t", "reply_to_message_id": 2}]}
    (tmp_path / "result.json").write_text(json.dumps(export))
    got = chats.read(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.author, r.via, r.text, r.media, r.media_kind, r.msg_id, r.reply_to, r.source_id) for r in got] == [("Ann", None, "ac", "p.jpg", "photo", "2", None, "tg7"), ("Cy", "Bob", "t", None, None, "3", "2", "tg7")]
    buffer = [dict(chat_id=1, message_id=5, chat_slug="s", date="2024-01-01", author_name="Ann", text="x", origin_type="hidden_user", origin_name="Z"), dict(chat_id=1, message_id=6, chat_slug="s", date="2024-01-01", author_name="Ann", file_id="f")]
    (tmp_path / "inbox.json").write_text(json.dumps(buffer))
    got = chats.read(spark, str(tmp_path / "inbox.json")).orderBy("pos").collect()
    assert [(r.author, r.via, r.attribution, r.shown_as, r.msg_id, r.media) for r in got] == [(None, "Ann", "forwarder-shown", "Z", "s:5", None), ("Ann", None, "reliable", None, "s:6", "files/s/6_file")]
    with pytest.raises(ValueError):
        chats.parse_capture(spark.createDataFrame([(0, json.dumps(buffer[0])), (1, json.dumps(buffer[0] | {"chat_slug": "other"}))], "pos long, value string"))
    assert chats.missing_keys([{"chat_slug": "s", "message_id": 1}]) == ["author_name", "chat_id", "date"] and chats.missing_keys([{}]) == []
    paste = tmp_path / "p.txt"
    paste.write_text("lost\n[01.02.2024 10:00] Dr: Who: hi\nmore\n[01.02.2024 10:01:09] Dr: Who: yes\n[01.02.2024 10:02] Ann:\n[01.02.2024 10:03] no name here\n")
    got = chats.read(spark, str(paste)).orderBy("pos").collect()
    assert [(r.date, r.author, r.text) for r in got] == [("2024-02-01T10:00:00", "Dr", "Who: hi\nmore"), ("2024-02-01T10:01:09", "Dr", "Who: yes"), ("2024-02-01T10:02:00", "Ann", chats.NO_TEXT), ("2024-02-01T10:03:00", "unknown", "no name here")]
    with pytest.raises(ValueError):
        chats.read(spark, str(tmp_path / "none.bin"))


def test_lists_and_links(spark, tmp_path):
    lines = spark.createDataFrame(list(enumerate(["- one :: i1, i2", "# note", "", " * two", ":: i3"])), "line_no long, value string")
    assert [(r.line_no, r.text, r.refs) for r in files.batch_lines(lines).orderBy("line_no").collect()] == [(0, "one", ["i1", "i2"]), (3, "two", []), (4, None, ["i3"])]
    docs = spark.createDataFrame([("d", "[a](x%20y.md#top) [b](https://z.test) [c](#here) [d](a+b.md) [a](x%20y.md)")], "doc string, text string")
    assert sorted(r.target for r in files.markdown_links(docs).collect()) == ["a+b.md", "x y.md"]
    (tmp_path / "_x").mkdir()
    (tmp_path / "_x" / ".hidden").write_bytes(b"abc")
    tree = files.raw_tree(spark, str(tmp_path)).collect()
    assert [(r.path, r.size) for r in tree] == [("_x/.hidden", 3)] and tree[0].sha256.startswith("ba7816bf")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "arc"))
    store.create()
    start = store.version()
    assert store.read("items").count() == 0
    items = insert(store.read("items"), spark.createDataFrame([("i1", "missing", "raw/a"), ("i2", "present", None)], "id string, status string, raw_path string"))
    one = store.commit({"items": items}, start)
    with pytest.raises(Conflict):
        store.commit({"items": items}, start)
    files_ = spark.createDataFrame([("raw/a", "h")], "path string, sha256 string")
    changed = fulfil_gaps(update(store.read("items"), spark.createDataFrame([("i2", "n", None)], "id string, fidelity_note string, status string")), files_)
    changed = redact(changed, "r1", spark.createDataFrame([("i2",), ("i2",)], "id string"))
    left, retired = retire(changed, store.read("retired"), spark.createDataFrame([("i1", "off-topic")], "id string, reason string"), F.lit("material"), "2024-01-01")
    store.commit({"items": left, "retired": retired}, one)
    assert [(r.id, r.status, r.fidelity_note, r.redactions) for r in store.read("items").collect()] == [("i2", "present", "n", ["r1"])]
    assert [tuple(r) for r in store.read("retired").collect()] == [("i1", "material", "off-topic", "2024-01-01")]
    assert archive.next_ids(store.read("items"), store.read("retired")).first().next == "i003"
    q = insert(store.read("questions"), spark.createDataFrame([("q1", "why")], "id string, text string"))
    marks = spark.createDataFrame([("q1", "Ann", "2024-01-02", "chat"), ("q1", "Bob", "2024-01-01", "mail")], "id string, `to` string, at string, `where` string")
    assert [m["to"] for m in append_marks(q, marks).first().raised] == ["Bob", "Ann"]
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"spec": "1.7", "export": {"slug": "s", "title": "T"}, "items": [{"id": "i9", "participants": ["A"]}]}))
    store.import_manifest(str(manifest))
    assert store.read("items").first().id == "i9" and store.read("people").count() == 0 and store.read("export").first().slug == "s"
    manifest.write_text(json.dumps({"spec": "2.0"}))
    with pytest.raises(ValueError):
        store.import_manifest(str(manifest))


def test_stream_takes_each_message_once(spark, tmp_path):
    data = rows(spark, [(i, "s", str(i % 5), "2024-01-01T10:00", "A", f"text number {i % 5}", None) for i in range(20)])
    for k in (0, 1):
        data.where(F.col("row_id") % 2 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    intake = Intake(spark, str(tmp_path / "out"))
    stream = spark.readStream.schema(data.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        intake.start(stream, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.msg_id for r in intake.table("messages", data.drop("key").schema).collect()) == ["0", "1", "2", "3", "4"]
    intake.batch(data, 7)
    intake.batch(data, 7)
    assert intake.table("messages", data.drop("key").schema).count() == 5


def test_render_and_publish(spark, tmp_path):
    from tracewell.operators import render
    from tracewell.session import WRITTEN, checkpoint, clean

    items = spark.createDataFrame([item(), item(id="i2", contour="public", date=None, participants=["A"], redactions=["r|1"]), item(id="i3", contour=None, status="missing", fidelity=None)], ITEM)
    reqs = spark.createDataFrame([("t2", "a quote", "A", ["i1"], "soon", None, "2024-01-01", ["r"]), ("t1", "other", None, None, "", None, None, None)], "id string, quote string, wanted_by string, based_on array<string>, blocking string, blocking_since string, date string, redactions array<string>")
    reqs = reqs.withColumn("stage", F.lit(None).cast("string")).withColumn("supersedes", F.lit(None).cast("string")).withColumn("note", F.lit("n"))
    lines = [(r.section, r.line) for r in render.index_lines(items, reqs, people(spark, [])).orderBy("section", "rank").collect()]
    assert lines[:5] == [(1, "items: 3"), (1, "requirements: 2"), (1, "people: 0"), (2, "| verbatim | 2 |"), (2, "| placeholder | 1 |")] and lines[-1] == (4, "| i3 | missing | raw/x/a.md |")
    assert [r.line for r in render.redaction_lines(items).collect()] == ["| r\\|1 | 1 |"]
    got = [json.loads(r.json) for r in render.contract_lines(reqs, archive.requirement_order(reqs, "2024-01-11"), masked=True).orderBy("rank").collect()]
    assert [(r["id"], r["quote"], r["days_blocked"], r["supersedes"]) for r in got] == [("t2", archive.MASK, 10, None), ("t1", "other", None, None)]
    note = spark.createDataFrame([("unknown", "Shown", "Via"), (None, "x", "y")], "a string, s string, v string").select(render.media_note(F.col("a"), F.col("s"), F.col("v")))
    assert [r[0] for r in note.collect()] == ["authorship unknown; shown as Shown; passed on by Via", None]
    reply = spark.createDataFrame([("Ann", False, "q\n# r", "b", "7", True), (None, False, None, "body", None, False), ("Ann", True, None, "body", None, True)], "n string, c boolean, q string, b string, no string, d boolean")
    assert [r[0] for r in reply.select(render.reply_lines(*(F.col(c) for c in reply.columns))).collect()] == ["> in reply to Ann (not confirmed) #7\n> q\n> \\# r", "> in reply to —\n> body", "> in reply to Ann"]
    store, slice_ = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    store.create()
    store.commit({"items": items}, store.version())
    assert render.publish(store, slice_)[1] == 2 and [(r.id, r.participants) for r in slice_.read("items").collect()] == [("i2", [])]
    render.guard(lint.v05(spark.createDataFrame([item()], ITEM)))
    with pytest.raises(ValueError, match="V05"):
        render.guard(lint.v05(spark.createDataFrame([item(fidelity="digest")], ITEM)))
    kept = checkpoint(spark.range(3))
    assert kept.count() == 3 and WRITTEN
    clean(spark)
    assert not WRITTEN


def test_alike_by_stems_or_letters(spark, monkeypatch):
    """Against brute force over all pairs; equal phrases are one class; in one block or in many."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(4)
    word = lambda: "".join(r.choice(["pri", "ce", "list", "de", "li", "very", "do", "cu", "ment", "ar", "chi"]) for _ in range(3))
    base = [" ".join(word() for _ in range(r.randrange(2, 7))) for _ in range(60)]
    data = [(f"t{i:03}", r.choice([x, x.upper() + "!", x[:-1], " ".join(reversed(x.split())), x.replace("e", "i")])) for i, x in enumerate(base * 2)] + [("t900", None), ("t901", ""), (None, "x"), ("t902", "a b")]
    df = spark.createDataFrame(data, "id string, text string").withColumn("t", F.lit("clash"))
    asked = df.where("id < 't020'")
    phrase = {k: " ".join(w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split() if len(w) > 2) for k, x in data if k}
    first = {}
    for k in sorted(phrase):
        first.setdefault(phrase[k], k)
    queries = {first[phrase[k]] for k in phrase if k < "t020" and phrase[k]}
    want = {}
    for q in queries:
        for p, k in first.items():
            a, b = {w[:5] for w in phrase[q].split()}, {w[:5] for w in p.split()}
            if a and b and k != q:
                best = max(len(a & b) / min(len(a), len(b)), SequenceMatcher(None, phrase[q], p).ratio())
                if best >= 0.62:
                    want[q, k] = round(best, 9)
    for size in (500, 7):
        monkeypatch.setattr(archive, "BLOCK_TEXTS", size)
        got = {(x["query"], x["id"]): round(x["similarity"], 9) for x in archive.alike_texts(asked, df).collect()}
        assert got == want and len(want) > 10
    assert archive.alike_texts(asked.limit(0), df).count() == 0 and archive.alike_texts(asked, df.limit(0)).count() == 0
    assert {(x["id"], x["class"]) for x in archive.phrase_classes(df).collect()} == {(k, first[p]) for k, p in phrase.items() if p}


def test_alike_in_bulk():
    """Like SequenceMatcher and stems for all pairs, at any length; a pair costs about a microsecond, not seventy."""
    import random
    import time
    from difflib import SequenceMatcher

    from tracewell.functions.alike import alike

    r = random.Random(5)
    text = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    texts = [text(n, letters) for n in (1, 2, 5, 62, 63, 64, 125, 126, 127, 128, 189, 190, 199, 200, 201, 260, 330) for letters in ("ab", "abc ", "abcdefgh ", "аб й", "a\U0001f33f\0")]
    texts += ["".join(r.choice([c, c, c, ""]) for c in x) or "a" for x in texts]
    rows = [(x, sorted({w[:5] for w in x.split(" ")})) for x in texts]
    got = {(a, b): c for part in alike(rows, rows[::-1], 0.62) for a, b, c in zip(*(x.tolist() for x in part))}
    want = {}
    for i, (x, s) in enumerate(rows):
        for j, (y, t) in enumerate(rows[::-1]):
            best = max(len(set(s) & set(t)) / min(len(s), len(t)), SequenceMatcher(None, x, y).ratio())
            if best >= 0.62:
                want[i, j] = best
    assert got == want and len(want) > 1000
    words = [text(r.randrange(3, 9), "etaoinshrdlu") for _ in range(400)]
    many = [[r.choice(words) for _ in range(10)] for _ in range(4_000)]
    many = [(" ".join(x), sorted({w[:5] for w in x})) for x in many]
    began = time.process_time()
    assert sum(len(part[0]) for part in alike(many[:100], many, 0.62)) >= 100
    assert time.process_time() - began < 6


def test_files_of_an_archive(spark):
    paths = spark.createDataFrame([("INDEX.md",), ("raw/a",), ("raw/b",), (".git/x",), ("tmp/y",)], "path string")
    assert sorted(r.place for r in lint.v07(paths).collect()) == sorted(x for x in lint.REQUIRED if x != "INDEX.md")
    assert [r.place for r in lint.v11(paths).collect()] == ["tmp"]
    things = spark.createDataFrame([item(id="i1", status="missing", raw_path="raw/a"), item(id="i2", raw_path="raw/b"), item(id="i3", raw_path="raw/b")], ITEM)
    assert [r.place for r in lint.v06_appeared(things, paths).collect()] == ["i1"] and [(r.place, r.message) for r in lint.v17(things).collect()] == [("i3", "file of i2")]
    cut = spark.createDataFrame([("r1", "pii", "x", True, "/out"), ("r1", "pii", "x", False, None), ("r2", "odd", " ", True, ""), ("r3", None, "x", None, "v/../in")], "id string, reason string, description string, reversible boolean, vault_ref string")
    assert sorted((r.place, r.message) for r in lint.v15(cut).collect()) == [("r1", "id repeated"), ("r2", "no description"), ("r2", "no place of the original"), ("r2", "reason outside its domain"), ("r3", "original inside the archive"), ("r3", "reason outside its domain")]
    assert tuple(lint.report(lint.v07(paths)).first()) == (False, 5, 0, False) and tuple(lint.report(lint.v07(paths).limit(0), True).first()) == (True, 0, 0, True)

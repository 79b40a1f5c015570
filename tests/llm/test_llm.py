"""Operators of the llm subpackage against brute force, round trips and held-out grades."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import conversations, leakage, linkage, names, packing, pii, reading, tokens

T0 = datetime(2024, 1, 1)
DATA = "/root/testdata/sf0.001"


# --- names (problem 3)
@pytest.mark.parametrize(
    "text, expected",
    [
        ("Ekaterina Zeskufoska", "=ekaterina|zeskufoska"), ("Zeskufoska, Katya", "=ekaterina|zeskufoska"), ("Катя Зескуфоска", "=ekaterina|zeskufoska"),
        ("EKATERINA ZESKUFOSKA 🌿", "=ekaterina|zeskufoska"), ("Nikolai_Zeskufoska", "=nikolai|zeskufoska"), ("RobertZeskufoska", "=robert|zeskufoska"),
        ("R. Zeskufoska", "r:zeskufoska"), ("Zeskufoska R.", "r:zeskufoska"), ("Rоbert Zeskufoska – PM", "=robert|zeskufoska"), ("Robert Zescoufosca (work)", "=robert|zeskufoska"),
        ("Gaboditse Trading GmbH", "+trading|gaboditse"), ("ООО «Габодице Трейдинг»", "+trading|gaboditse"), ("gaboditse trd.", "+trading|gaboditse"), ("Zeskuvo GmbH", "zeskuvo"), ("Foo Bakery", "bakery|fo"), ("Foo Bakery Ltd", "bakery|fo"),
        ("Jonathan Miller", "jonathan|miler"), ("Miller, Jonathan", "jonathan|miler"), ("Jonathan J. Miller", "jonathan|miler"), ("Fatima O'Brien", "fatima|obrien"), ("Maria del Carmen Garcia Lopez", "del|garkia|karmen|lopez|maria"),
        ("Katya", None), ("", None), (None, None), ("@katya_z", None), ("a.b@mail.example", None), ("🌿", None), ("x", None),
    ],
)
def test_parse(text, expected):
    kind, first, words = names.parse(text)
    assert (None if kind == "none" else f"{first}:{words[0]}" if kind == "initial" else "|".join(words)) == expected


def test_accounts():
    assert {names.account(x) for x in ("@Ab_c", "tg:ab_c", " AB_C ", "https://t.me/ab_c")} == {"ab_c"}
    assert names.digits("abc55x") == "55" and names.digits("abc552@x1.test") == "552" and names.digits("abc") == ""
    assert names.account_names("jonathan.miller") == (["jonathan|miler", "jonathan|miler"], [("j", "miler"), ("m", "jonathan")]) and names.account_names("jmiller7") == ([], [("j", "miler"), ("r", "jmile")])


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_edits(a, b):
    assert names.osa(a, b) == names.osa(b, a) and abs(len(a) - len(b)) <= names.osa(a, b) <= max(len(a), len(b)) and (names.osa(a, b) == 0) == (a == b)


def misspelt(r, w):
    """A word with one edit, or two in a long one: left out, put in, changed or swapped letters."""
    for _ in range(2 if len(w) >= 9 and r.random() < 0.4 else 1):
        i, how = r.randrange(len(w) - 1), r.choice("dics")
        c = r.choice("abcdefghijklmnoprstuvz")
        w = {"d": w[:i] + w[i + 1 :], "i": w[:i] + c + w[i:], "c": w[:i] + c + w[i + 1 :], "s": w[:i] + w[i + 1] + w[i] + w[i + 2 :]}[how]
    return w


def test_recall_of_names_off_the_list(spark):
    """Misspelt, reordered names of which no table knows a word: what verification accepts meets, by brute force."""
    r = random.Random(3)
    sounds = ["mar", "ten", "jo", "li", "bel", "ka", "ro", "sen", "vi", "tho", "gre", "nu", "pal", "die", "ster"]
    word = lambda: "".join(r.choice(sounds) for _ in range(r.choice([2, 2, 3, 3])))
    firsts = [word() for _ in range(25)]
    people_ = [[r.choice(firsts), word()] for _ in range(500)]
    texts = [x for p in people_ for x in (p, [misspelt(r, p[0]), p[1]], [p[1], misspelt(r, p[0])] if r.random() < 0.5 else [misspelt(r, p[1]), p[0]], [misspelt(r, p[0]), misspelt(r, p[1])])]
    keys = sorted({"|".join(names.parse(" ".join(x))[2]) for x in texts})
    df = spark.createDataFrame([(k, k.split("|"), True) for k in keys], "key string, words array<string>, listed boolean")
    near = linkage.near_words(linkage._words(df).withColumn("common", F.lit(False)))
    near = near.select("word", "near").unionByName(near.select(F.col("near").alias("word"), F.col("word").alias("near")))
    got = {(x.key, x.near) for x in linkage.near_keys(df, near).collect()}
    alike = lambda a, b: names.likeness(a, b) >= linkage.LEAST_WORD
    listed = [k.split("|") for k in keys]
    every = set()
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if len(a) == len(b) and any(alike(x, y) for x in a for y in b) and names.monge_elkan(a, b) >= linkage.LEAST_SIMILARITY and sum(x not in b for x in a) <= 2 and all(any(alike(x, y) for y in b) for x in a):
                every |= {("|".join(a), "|".join(b)), ("|".join(b), "|".join(a))}
    assert len(every) > 1500 and len(got & every) / len(every) >= 0.97 and got <= every


def test_no_words_alike_are_left_out(spark):
    """All words alike meet, by brute force: at the least likeness, of any length, swapped, however many names have them."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abdeiklmnorstuvz") for _ in range(n))
    words = [word(n) for n in (3, 4, 5, 6, 8, 9, 9, 10, 12, 13, 14, 16, 18, 23, 27, 32, 41, 112) for _ in range(6)]
    other = lambda w: w[: (i := r.randrange(len(w) - 1))] + r.choice([w[i + 1] + w[i] + w[i + 2 :], w[i + 1 :], r.choice("aeiou") + w[i + 1 :], r.choice("aeiou") + w[i:]])
    for w in list(words):
        for _ in range(6):
            x = w
            for _ in range(max(1, int((1 - linkage.LEAST_WORD) * len(w) + 1e-9))):
                x = other(x)
            words.append(x)
    words = sorted({w for w in words if w})
    every = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) < 30 and names.likeness(a, b) >= linkage.LEAST_WORD}
    keys = [(f"{w}|{x}", [w, x], True) for w in words for x in (f"q{i:02}" for i in range(20))]
    df = linkage._words(spark.createDataFrame(keys, "key string, words array<string>, listed boolean"))
    got = [(x.word, x.near) for x in linkage.near_words(df).collect()]
    assert len(got) == len(set(got)) and {p for p in got if p[0][0] != "q" or len(p[0]) != 3} == every and len(every) > 400


def test_names_of_many_words(spark):
    """A misspelt name of more than a dozen words meets the name."""
    words = sorted({f"{a}{b}ter" for a in ("mar", "ten", "bel", "ka") for b in ("ros", "vin", "gul", "pad")})
    wrong = sorted([*words[1:], words[0][:-1] + "n"])
    df = spark.createDataFrame([("|".join(x), x, True) for x in (words, wrong)], "key string, words array<string>, listed boolean")
    near = linkage.near_words(linkage._words(df))
    near = near.select("word", "near").unionByName(near.select(F.col("near").alias("word"), F.col("word").alias("near")))
    assert {(x.key, x.near) for x in linkage.near_keys(df, near).collect()} == {("|".join(words), "|".join(wrong)), ("|".join(wrong), "|".join(words))}


PEOPLE = "id string, display string, role string, aliases array<string>, handles map<string,string>, note string, key string, cluster int"


def people(spark, data):
    return spark.createDataFrame([(r[0], r[1], "x", a, h, None, "k", 1) for r, a, h in data], PEOPLE)


def test_linkage_off_the_list(spark):
    """Names that no table knows: misspelt, reordered, shortened, of five words, short; other people stay apart."""
    data = [
        (("a1", "Jonathan Miller"), None, {"email": "j@x.test"}), (("a2", "Miller Jonathan"), [], None), (("a3", "Jonathon Miller"), None, None), (("b1", "Marianne Miller"), None, None), (("c1", "Maria del Carmen Garcia Lopez"), None, None),
        (("c2", "Garcia Lopez, Maria del Carmen"), None, None), (("d1", "Robert Kim"), None, None), (("d2", "Kim Robert"), None, None), (("e1", "Foo Bakery Ltd"), None, None), (("e2", "Foo Bakery"), None, None),
    ]
    df = people(spark, data)
    members = linkage.entities(df)[0]
    assert {(r.left_key, r.right_key) for r in linkage.link_people(members).collect()} == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("c1", "c2"), ("d1", "d2"), ("e1", "e2")}
    authors = spark.createDataFrame([(x,) for x in ("Jonathan Millre", "J. Miller", "Miler J.", "jonathan.miller", "Marianne Miller", "Kim, Robert", "Jonas Miller")], "author string")
    got = defaultdict(set)
    for r in linkage.links(df, authors).where("kind = 'author'").collect():
        got[r.left_key].add(r.right_key)
    one = {"a1", "a2", "a3"}
    assert got == {"Jonathan Millre": one, "J. Miller": one, "Miler J.": one, "jonathan.miller": one, "Marianne Miller": {"b1"}, "Kim, Robert": {"d1", "d2"}}


def test_two_addresses_of_one_row(spark):
    """All accounts of a repeated row count: two addresses join the rows that have one of them each."""
    data = [(("p1", "Robert Zeskufoska"), None, {"email": "a@x.test"}), (("p1", "Robert Zeskufoska"), None, {"email": "b@x.test"}), (("p2", "Robert Zeskufoska"), None, {"email": "b@x.test"}), (("p3", "R. Zes"), None, {"email": "A@x.test"}), (("p4", "Robert Zeskufoska"), None, {"email": "c@x.test"})]
    members = linkage.entities(people(spark, data))[0]
    assert {(r.left_key, r.right_key) for r in linkage.link_people(members).collect()} == {("p1", "p2"), ("p1", "p3"), ("p2", "p3")}


def test_components(spark):
    """A long chain is one component after few rounds."""
    df = spark.createDataFrame([(f"{i:03}", f"x{i + d}") for i in range(120) for d in (0, 1)] + [("z", "y")], "node string, at string")
    got = {r.node: r.label for r in linkage.components(df).collect()}
    assert set(got.values()) == {"000"} and len(got) == 120 and linkage.components(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abc")), st.integers(1, 6)), max_size=6, unique_by=lambda x: tuple(sorted(x[0]))))
def test_settlement(counts):
    """Every unit has one cluster, and no cluster has a kind of account twice."""
    ranges, held = linkage._settle([(",".join(sorted(k)), n) for k, n in counts]), defaultdict(list)
    for shape, low, high, base in ranges:
        for i in range(low, high + 1):
            held[base + i - low] += shape.split(",") if shape else []
    assert {s: sum(h - lo + 1 for x, lo, h, _ in ranges if x == s) for s, *_ in ranges} == {",".join(sorted(k)): n for k, n in counts}
    assert all(len(x) == len(set(x)) for x in held.values()) and len(held) >= max((sum(n for k, n in counts if c in k) for c in "abc"), default=0)


def test_linkage(spark):
    data = [
        (("p1", "Robert Zeskufoska"), ["Rob"], {"email": "r.z@x.test", "telegram": "rzes"}), (("p2", "Zeskufoska, Robert"), None, {"telegram": "@Rzes"}), (("p3", "Robert Zeskufosak"), [], {}),
        (("p4", "Robert Zeskufoska"), [], {"email": "r.z2@x.test", "telegram": "rzes5x"}), (("p5", "Nikolai Zeskufoska"), ["Kolya"], None), (("p6", "Gaboditse Trading GmbH"), ["ООО «Габодице Трейдинг»"], {"site": "gab.example"}),
        (("p7", "Gaboditse Trd."), None, None), (("p8", None), None, None), (("p9", "X."), None, {"email": "R.Z@X.TEST"}), (("p9", "X."), None, {"email": "R.Z@X.TEST"}), (("q1", "Kolya"), None, None), (("q2", "Kolya"), None, None),
    ]
    df = people(spark, data)
    members = linkage.entities(df)[0]
    pairs = {(r.left_key, r.right_key) for r in linkage.link_people(members).collect()}
    assert pairs == {("p1", "p2"), ("p1", "p3"), ("p1", "p9"), ("p2", "p3"), ("p2", "p9"), ("p3", "p9"), ("p6", "p7")}
    authors = ["Роберт Зескуфоска", "@rzes", "tg:rzes5x", "N. Zeskufoska", "Nikolai Zeskufoskka", "GABODITSE TRADING", "Deleted Account", "Kolya", "Robert Unknownovich", "", None, "nikolai.zeskufoska"]
    got = defaultdict(set)
    for r in linkage.links(df, spark.createDataFrame([(a, 1) for a in authors], "author string, id int")).where("kind = 'author'").collect():
        got[r.left_key].add(r.right_key)
    one, two = {"p1", "p2", "p3", "p9"}, {"p4"}
    assert got == {"Роберт Зескуфоска": one | two, "@rzes": one, "tg:rzes5x": two, "N. Zeskufoska": {"p5"}, "Nikolai Zeskufoskka": {"p5"}, "GABODITSE TRADING": {"p6", "p7"}, "nikolai.zeskufoska": {"p5"}}


def test_many_namesakes(spark):
    """Twelve holders of one name: the rows of each are one, also of those that come last."""
    data = [(f"{i:02}{c}", "Robert Zeskufoska", [], h) for i in range(11) for c, h in (("a", {"email": f"r{i}@x.test", "telegram": f"rzes{i}"}), ("b", {"telegram": f"@Rzes{i}"}), ("c", {"email": f"R{i}@x.test", "site": f"z{i}.example"}))]
    data += [("11a", "Robert Zeskufoska", [], {"email": "r11@x.test"}), ("11b", "Zeskufoska, Robert", [], {"telegram": "rzes11"})]
    df = people(spark, [((i, d), a, h) for i, d, a, h in data])
    members = linkage.entities(df)[0]
    assert len({r.id for r in members.collect()}) == members.count() == len(data)
    pairs = {(r.left_key, r.right_key) for r in linkage.link_people(members).collect()}
    assert pairs == {(f"{i:02}{x}", f"{i:02}{y}") for i in range(12) for x, y in ("ab", "ac", "bc") if i < 11 or y == "b"}
    authors = spark.createDataFrame([("rzes11",), ("rzes3",)], "author string")
    got = {(r.left_key, r.right_key) for r in linkage.links(df, authors).where("kind = 'author'").collect()}
    assert got == {("rzes11", "11a"), ("rzes11", "11b")} | {("rzes3", f"03{c}") for c in "abc"}


def test_linkage_of_nothing(spark):
    members = linkage.entities(people(spark, []))[0]
    assert members.count() == 0


def test_stars(spark):
    """A chain is not one cluster: satellites touch their centre."""
    keys = spark.createDataFrame([(k, w) for k, w in zip("abcde", (1, 9, 1, 5, 1))], "key string, weight long")
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "key string, near string")
    assert {r.key: r.centre for r in linkage.stars(keys.unionByName(spark.createDataFrame([("f", 1)], "key string, weight long")), edges).collect()} == {"a": "b", "b": "b", "c": "b", "d": "d", "e": "d", "f": "f"}


# --- personal information (problem 5)
def places(spark, texts):
    df = spark.createDataFrame([("m", str(i), t, 0) for i, t in enumerate(texts)], "tbl string, rec_id string, text string, bits int")
    found = pii.places(df)
    return df, found, {(r.kind, texts[int(r.rec_id)][r.start_pos : r.end_pos]) for r in found.collect()}


FORMS = {
    "email": ["ann.lee+x@mail.example", "a_b [at] x.example".replace(" [at] ", "[at]"), "ann (at) mail (dot) example", "ann @ mail.example", "ann собака mail.example", "ANN@MAIL.EXAMPLE"],
    "phone": ["+44 7700 900123", "+74950004456", "8 (495) 000-10-85", "(312) 555-0149", "202.555.0170", "0049 69 90009 114", "020 7946 0707", "415-555-2671", "+49 30 23125-483", "+1 202 555 0178"],
    "identity": ["QQ 12 34 56 A", "QQ123456B", "00 24 700584", "000-443-362 81", "666-81-3422", "I2Y759P19"],
    "address": ["Flat 9, 12 Harrow Road", "12B Harrow Ave, Eastmoor", "12 Harrow St., Apt 3", "7 Quarry Lane", "42 Kensal Rise Mews", "Calle Mayor 12, Madrid", "12 rue de Rivoli", "Oakmere Court 9", "12 saltmarsh street", "ул. Луговая, д. 175, кв. 73", "ул. Кленовая 96-62", "улица Кузнечная, дом 109", "Садовая улица, 34", "Gartenstr. 105, 00866 Pellbridge", "Am Gartenplatz 238", "Quellenstraße 217", "Mühlenweg 9a"],
}


def test_forms(spark):
    texts = [f"🌿 so {x}, that is it" for xs in FORMS.values() for x in xs]
    assert places(spark, texts)[2] == {(k, x) for k, xs in FORMS.items() for x in xs}


def test_no_cases(spark):
    texts = ["Invoice 123456789012 is paid", "Order 4155552671 left", "ping @night_shift about it", "See https://wiki.corp.test/15542e1522 now", "Parcel TR895695745XX left on 2023-06-10.", "Batch #1246757 and 9162674465, RQ-7272-97", "Build 0.24.483 fails on 192.0.2.45.", "Paid 71 943 726,00 for it", "Put it in lane 7, bay 34", "The Quarry Lane dashboard shows 9 rows.", "Commit 0dd85037df", "Kate, Found 72", "thanks, Dima!", "", None, "column F.", "\0\n\0", "x" * 100_000]
    assert places(spark, texts)[2] == set()


def corpus(r):
    """Texts with names of 40 people, and of many who share one surname, among ordinary sentences."""
    given = ["Robert", "Nikolai", "Katya", "Yulia", "Хенк", "Tatiana", "Pavel", "Sofia"]
    lasts = ["".join(r.choice(["zes", "ku", "fo", "bra", "vli", "nu", "ga"]) for _ in range(4)) for _ in range(40)]
    out, known = [], [(r.choice(given), s.capitalize()) for s in lasts]
    for i in range(400):
        g, s = r.choice(known) if i % 4 else (given[i // 4 % len(given)], "Brauner")
        name = r.choice([f"{g} {s}", f"{s} {g}", f"{g[0]}. {s}", f"{s}, {g[0]}.", f"{g.lower()} {s.lower()}" if g.isascii() and g != "Katya" else f"{g} {s}"])
        out.append((r.choice([f"Call {name} today.", f"{name} will check it", f"No news from {name}\nsince then"]), name))
        out.append((r.choice([f"Call {g} today.", f"{g} wants to check it", "No news since then", f"{g} will see the column F.", f"Thanks {g}"]), None))
    return out


def test_names_by_disclosure(spark):
    cases = corpus(random.Random(5))
    _, found, _ = places(spark, [t for t, _ in cases])
    got = {(r.rec_id, cases[int(r.rec_id)][0][r.start_pos : r.end_pos]) for r in found.collect()}
    assert got == {(str(i), n) for i, (_, n) in enumerate(cases) if n}


def test_given_names_are_learned(spark):
    """Names of which the table knows nothing: given names come from the registry and from the texts, surnames are of any
    length, double, with an apostrophe, with a middle name; a person whom many call by the surname alone is still found."""
    r = random.Random(7)
    sounds = ["mar", "ten", "jo", "li", "bel", "ka", "ro", "sen", "vi", "tho", "gre", "nu", "pal", "die", "ster"]
    word = lambda n: "".join(r.choice(sounds) for _ in range(n)).capitalize()
    given = ["Jonathan", "Fatima", "Anneke", "Matteo", "Ingrid", "Rafael"]
    lasts = sorted({word(3) for _ in range(60)})
    staff = [(f"p{i}", f"{given[i % 6]} {x}", [f"{x} {given[i % 6]}", f"{given[i % 6]} {x} (work)"]) for i, x in enumerate(lasts)] + [(f"f{i}", f"{word(2)} Bakery Ltd", None) for i in range(8)]
    registry = spark.createDataFrame(staff, "id string, display string, aliases array<string>")
    known = {g.lower() for g in given}
    talk = [f"We asked {g} {x} about it." for g in ("Leonor",) for x in lasts[:8]] + [f"We asked Frau {x} about it." for x in lasts[20:40]] + [f"Please ask {x} about it" for x in lasts[20:40]]
    texts = spark.createDataFrame([(x,) for x in talk] + [(None,)], "text string")
    assert pii.learned_given(registry, texts) == known | {"leonor"}
    names_ = ["Jonathan Kim", "Fatima O'Brien", "Anneke Meyer-Schmidt", "Matteo Lee", "Leonor Quint", "Ingrid J. Halvorsten", "Rafael Matteo Ostrander", "Halvorsten, I."]
    cases = [(t, n) for n in names_ for t in (f"Call {n} today.", f"We met {n} and left")] + [(t, None) for g in given for t in (f"Thanks {g}", f"{g} wants to go", f"We saw {g} today", f"{g} left")]
    cases += [("We met Ingrid Stavanger and left", "Ingrid Stavanger")] * 25 + [("ask Stavanger about it", None)] * 60 + [(x, None) for x in talk]
    df = spark.createDataFrame([("m", str(i), t) for i, (t, _) in enumerate(cases)], "tbl string, rec_id string, text string")
    got = {(x.rec_id, cases[int(x.rec_id)][0][x.start_pos : x.end_pos]) for x in pii.places(df, registry).collect()}
    assert {x for x in got if cases[int(x[0])][1]} == {(str(i), n) for i, (_, n) in enumerate(cases) if n}
    assert {n for i, n in got if not cases[int(i)][1]} == {f"Leonor {x}" for x in lasts[:8]}


def test_numbers_by_the_word_before_them(spark):
    """Numbers of a form that things have too are a person's where the word before them stands before a person's numbers."""
    texts = [f"ID 666-8{i}-3422 of it" for i in range(5)] + [f"Tel. 202.555.017{i} now" for i in range(5)] + [f"invoice 12345678901{i} is paid" for i in range(5)] + [f"row {i}234567 and" for i in range(8)]
    texts += ["ID 001411742882.", "ID AB1234567, ok", "Tel. 4155552671", "row 4155552671", "Номер 001411742882", "(no 001411742882)"]
    assert {x for x in places(spark, texts)[2] if not x[1].startswith(("666", "202"))} == {("identity", "001411742882"), ("identity", "AB1234567"), ("phone", "4155552671")}


def test_replacement_keeps_the_rest(spark):
    texts = ["🌿 write to ann@mail.example or +44 7700 900123, ok?", "nothing here", None, "", "ann@mail.example"]
    df, found, _ = places(spark, texts)
    got = {r.rec_id: r.text for r in pii.replace(df, found).collect()}
    assert [got[str(i)] for i in range(5)] == ["🌿 write to [EMAIL] or [PHONE], ok?", "nothing here", None, "", "[EMAIL]"]


def test_places_of_nothing(spark):
    df = spark.createDataFrame([], "tbl string, rec_id string, text string")
    assert pii.places(df).count() == 0


# --- conversations (problem 6)
MESSAGES = "row_id long, chat_slug string, msg_id string, reply_to string, date string, author string, text string, received_at timestamp_ntz, root string, level int"


def test_conversations_against_brute_force(spark):
    r = random.Random(11)
    rows, k = [], 0
    for chat in ("a", "b", None):
        for n in range(1, 120):
            up = r.choice([None, None, *range(max(1, n - 6), n)]) if r.random() < 0.97 else r.choice([999, n, n + 1])
            date = r.choice(["2024-01-05T10:00:00", f"2024-01-05T{r.randrange(10, 20)}:00:00", "1704448800"]) if r.random() < 0.985 else r.choice(["yesterday", None])
            for copy in range(r.choice([1, 1, 2])):
                k += 1
                rows.append((k, chat, r.choice([str(n), f"{n}.0", f" {n}"]), None if up is None else f"{up}\n", date, r.choice(["A", "B", None, "Deleted Account"]), r.choice(["x", " ", None, "y"]), T0 + timedelta(seconds=r.randrange(3)), "r", 0))
    chats = spark.createDataFrame([("a", "Europe/Berlin"), ("b", "UTC")], "chat_slug string, tz_name string")
    got = {(x.chat_slug, x.root_no, x.msg_no, x.turn) for x in conversations.conversation_rows(spark.createDataFrame(rows, MESSAGES), chats).collect()}
    kept = {}
    for row in sorted(rows, key=lambda x: (x[7], x[0])):
        kept.setdefault((row[1], int(float(row[2]))), row)
    zone = {"a": -3600, "b": 0}
    from datetime import timezone

    def instant(key, date):
        if date is None or date == "yesterday":
            return None
        return int(date) if date.isdigit() else int(datetime.fromisoformat(date).replace(tzinfo=timezone.utc).timestamp()) + zone[key[0]]

    groups, bad = defaultdict(list), set()
    for key in kept:
        if key[0] is None:
            continue
        seen, x = [], key
        while x in kept and x not in seen:
            seen.append(x)
            up = kept[x][3]
            if up is None:
                groups[x].append(key)
                break
            x = (x[0], int(up))
    children = {(k_[0], int(v[3])) for k_, v in kept.items() if v[3] is not None}
    expected = set()
    for root, keys in groups.items():
        if len(keys) == 1 and root not in children:
            continue
        times = {x: instant(x, kept[x][4]) for x in keys}
        speakers = {kept[x][5] for x in keys} - {None, "Deleted Account"}
        if None in times.values() or len(speakers) < 2 or not any((kept[x][6] or "").strip() for x in keys):
            continue
        for turn, x in enumerate(sorted(keys, key=lambda x: (times[x], x[1])), 1):
            expected.add((x[0], root[1], x[1], turn))
    assert got == expected and len(expected) > 50 and not bad


def test_roles_and_alternation(spark):
    turns = spark.createDataFrame([("a", 1, n, t, w) for n, t, w in ((1, 1, "Ann"), (2, 2, "ann "), (3, 3, "Bob"), (4, 4, None))], "chat_slug string, root_no long, msg_no long, turn long, author string")
    staff = spark.createDataFrame([("p2", "Ann", "client", None, None), ("p1", "x", "self", ["ANN"], {"a": "b"})], "id string, display string, role string, aliases array<string>, handles map<string,string>")
    assert [r.role for r in conversations.with_roles(turns, staff).orderBy("turn").collect()] == ["self", "self", None, None]
    links = spark.createDataFrame([("Bob", "p2"), ("Ann", "p2")], "author string, id string")
    rows = conversations.with_roles(turns, staff, links).orderBy("turn")
    assert [r.role for r in rows.collect()] == ["client", "self", "client", None]
    assert tuple(conversations.alternation(rows).first())[2:] == (4, 3, 3, 3)


def test_cycles_of_replies(spark):
    """Messages on a cycle, and those that answer one, are reported and belong to no conversation."""
    up = {1: None, 2: 1, 3: 2, 10: 11, 11: 12, 12: 10, 13: 10, 14: 13, 20: 20, 30: 99}
    rows = [(n, "a", str(n), None if u is None else str(u), "2024-01-05", "AB"[n % 2], "x", T0, "r", 0) for n, u in up.items()]
    df = spark.createDataFrame(rows, MESSAGES)
    assert {(r.msg_no, r.reply_no) for r in conversations.endless_rows(df).collect()} == {(n, up[n]) for n in (10, 11, 12, 13, 14, 20)}
    chats = spark.createDataFrame([("a", "UTC")], "chat_slug string, tz_name string")
    assert {r.msg_no for r in conversations.conversation_rows(df, chats).collect()} == {1, 2, 3}


# --- packing (problem 8)
@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_uses_everything_once(counts):
    used = defaultdict(int)
    windows = packing.plan(counts, 60)
    for lengths, times in windows:
        assert sum(k * n for k, n in lengths.items()) <= 60 and times > 0
        for k, n in lengths.items():
            used[k] += n * times
    assert dict(used) == counts
    total, bins = sum(k * n for k, n in counts.items()), sum(t for _, t in windows)
    assert bins <= max(1, 2 * total / 60 + 1)


def test_exact_complement():
    have = packing.Lengths({7: 1, 20: 2, 30: 1}, 100)
    assert have.exact(30) == [30] and have.exact(40) == [20, 20] and sorted(have.exact(57)) == [7, 20, 30] and have.exact(14) is None and have.exact(60) is None
    assert have.longest(29) == 20 and have.longest(6) == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=12), st.integers(1, 60))
def test_exact_complements_against_brute_force(counts, gap):
    """A combination of one, two or three is found if there is one."""
    from itertools import combinations

    pieces_ = [k for k, n in counts.items() for _ in range(n)]
    found = packing.Lengths(counts, 60).exact(gap)
    assert (found is not None) == any(sum(c) == gap for m in (1, 2, 3) for c in combinations(pieces_, m))
    assert found is None or sum(found) == gap and all(found.count(k) <= counts[k] for k in found)


def test_large_windows():
    """All lengths up to 131,072 are planned in seconds."""
    import time

    r, began = random.Random(1), time.time()
    windows = packing.plan({k: r.choice([1, 1, 2, 5]) for k in range(1, 131_073)}, 131_072)
    used = sum(k * n * t for lengths, t in windows for k, n in lengths.items())
    assert time.time() - began < 60 and used / (131_072 * sum(t for _, t in windows)) > 0.99


def test_pack(spark):
    r = random.Random(2)
    data = [(i, r.choice([0, 5, 17, 17, 17, 60, 130, None])) for i in range(300)] + [(1, 17), (1, 17)]
    df = spark.createDataFrame(data, "id long, tokens long").withColumn("length", F.lit(1))
    caps = spark.createDataFrame([("s", 50), ("l", 200), ("none", 0), ("s", 50)], "window_name string, capacity_tokens long")
    packed = packing.pack(df, caps).collect()
    for name, cap in (("s", 50), ("l", 200)):
        own = [p for p in packed if p.window_name == name]
        room = defaultdict(int)
        for p in own:
            room[p.window_no] += p.length
        assert max(room.values()) <= cap and set(room) == set(range(len(room)))
        assert sum(p.length for p in own) == sum(n or 0 for _, n in data)
        whole = defaultdict(int)
        for p in own:
            whole[p.id] += p.length
        assert whole == {i: sum(n or 0 for j, n in data if j == i) for i in {j for j, n in data if n}}
        assert all(p.start % cap == 0 for p in own) and all(p.piece == 0 for p in own if dict(data[:300]).get(p.id, 0) and dict(data[:300])[p.id] <= cap and p.id != 1)
    assert {p.window_name for p in packed} == {"s", "l"}
    assert packing.pack(df.limit(0), caps).count() == 0
    assert packing.fill(packing.pack(df, caps), caps).where("fill > 0.9").count() == 2


def test_tokens(spark):
    texts = ["Hello world", "", None, "<|endoftext|>", "Привет", "x" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", tokens.token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    e = tokens.encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    assert got == [len(e.encode_ordinary(t)) if t else 0 for t in texts]


# --- leakage (problem 9)
ITEMS = [
    (1, "Records from Branellon mention neither the turbines nor the 61 retired guards. Since 42 boats from Kalellhal had sunk, Branellon began paying its glazier in chisels. The acting notary of Kalellhal counted 17 barometers and wrote 640 in the margin."),
    (2, "Records from Venirra mention neither the mirrors nor the 23 deputy guards. Since 90 boats from Merirria had sunk, Venirra began paying its printer in ledgers. The retired notary of Merirria counted 55 sextants and wrote 127 in the margin."),
    (3, "Между Osambul и Selosthal лежит 6 вёрст, однако дорога занимает 374 дней. За 39 зим Osambul потерял больше саженцев, чем Selosthal за 451 лет."),
    (4, None), (5, ""),
]
FILL = "We read the table together and found only small mistakes. " * 5


def variants():
    one = ITEMS[0][1]
    parts = one.split(". ")
    ocr = one.replace("l", "1").replace("o", "0", 3).replace("m", "rn")
    alike = one.replace("a", "а").replace("e", "е").replace("o", "о")
    words = one.split()
    swapped = " ".join(w if i % 6 else "thing" for i, w in enumerate(words))
    dropped = " ".join(w for i, w in enumerate(words) if i % 7 != 3)
    typos = " ".join(w[:2] + w[3:] if i % 5 == 0 and len(w) > 6 else w for i, w in enumerate(words))
    wrapped = "\n> ".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    good = [one, one.upper(), one.lower().replace(".", "").replace(",", ""), one.replace(" ", "  "), ocr, alike, swapped, dropped, typos, wrapped, parts[1], f"{parts[2]} {FILL} {parts[0]}", f"{parts[2]}. {parts[1]}. {parts[0]}"]
    return [FILL + x + " " + FILL for x in good]


def test_leaks(spark):
    good = variants()
    other = [ITEMS[0][1].replace("Branellon", "Ulerkum").replace("Kalellhal", "Selingrul").replace("61", "62").replace("42", "88").replace("17", "19").replace("640", "222"), "counted 17 barometers and", FILL, "", None, "Which statement is correct? Choose the correct answer.", "Records from the office mention neither the date nor the 61 pages."]
    docs = [(i, t, "c") for i, t in enumerate(good + other + [f"{ITEMS[1][1]} {ITEMS[2][1]}", ITEMS[2][1].replace("о", "o").lower()] + [good[0]])]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS + [(9, ITEMS[0][1])], "item_id long, prompt string").withColumn("text", F.lit("clash"))
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaks(df, items).collect())
    n = len(good) + len(other)
    assert got == sorted([(i, k) for i in [*range(len(good)), n + 2] for k in (1, 9)] + [(n, 2), (n, 3), (n + 1, 3)])
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_quarter_of_an_item(spark):
    """A quarter of an item's words is a leak, also with words changed inside; other names and figures are none."""
    n, words = len(leakage.words(ITEMS[0][1])), ITEMS[0][1].split()
    first = " ".join(words[2 : 2 + -(-n // 4)])
    changed = " ".join(words[: -(-n // 4) + 1]).replace("mention", "thing")
    other = " ".join(words[: -(-n // 4) + 1]).replace("Branellon", "Ulerkum").replace("61", "88")
    less = " ".join(words[2 : n // 5])
    df = spark.createDataFrame([(i, f"{FILL} {x}. {FILL}") for i, x in enumerate([first, changed, other, less])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(df, spark.createDataFrame(ITEMS, "item_id long, prompt string")).collect()} == {(0, 1), (1, 1)}


def test_leaks_of_shared_prompts(spark):
    """Prompts and passages that many items share, with names only or common words only, count for all of them."""
    r = random.Random(3)
    sounds = ["".join(r.choice(["zes", "ku", "fo", "bra", "vli", "nu", "ga"]) for _ in range(4)) for _ in range(400)]
    shared = "The quiet bridge of Vostrilla was painted by Ganderik before the long winter and nobody in Vostrilla thanked Ganderik for the colour"
    plain = "one of the two is more than the other and both of them are less than all that we have here"
    copied = "When Umberlot came home the silent keeper of Harkonsel gave away every lantern that Umberlot had bought in Harkonsel"
    items = [(i, copied) for i in range(20)] + [(20 + i, f"{shared}. {sounds[3 * i]} asked {sounds[3 * i + 1]} about {sounds[3 * i + 2]}") for i in range(20)]
    items += [(40 + i, f"{w} {plain}" if i else plain) for i, w in enumerate(r.sample(sounds, 20))]
    df = spark.createDataFrame([(i, f"{FILL} {x}. {FILL}") for i, x in enumerate([copied, shared, plain, "the one that we have is here and the other is less"])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, spark.createDataFrame(items, "item_id long, prompt string")).collect()}
    assert got == {(i // 20, i) for i in range(60)}


def test_leaks_do_not_depend_on_the_spread(spark, monkeypatch):
    """The same pairs, however items and documents are spread over tasks, and without anything sent to every task."""
    items = pq.read_table(f"{DATA}/eval_items.parquet").select(["item_id", "prompt"]).to_pandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(variants())], "doc_id long, text string"))
    items = spark.createDataFrame(items).unionByName(spark.createDataFrame(ITEMS, "item_id long, prompt string"))
    whole = sorted(map(tuple, leakage.leaks(docs.coalesce(1), items.coalesce(1)).collect()))
    assert len(whole) >= len(variants())
    for parts in (2, 40):
        assert sorted(map(tuple, leakage.leaks(docs.repartition(3), items.repartition(parts)).collect())) == whole
    for name in ("SEEDS_AT_ONCE", "ITEMS_AT_ONCE", "DOCS_AT_ONCE"):
        monkeypatch.setattr(leakage, name, 0)
    assert sorted(map(tuple, leakage.leaks(docs, items).collect())) == whole


# --- reading level (problem 10)
def graded(r, n):
    vocabulary = {1: "box cup red is on the it", 2: "folder because after wanted early copy", 3: "schedule supplier confirmed remaining entries version", 4: "coordination procedure responsibilities modification accountability", 5: "notwithstanding epistemic jurisdiction presumption attestations"}
    out = []
    for i in range(n):
        level = 1 + i % 5
        sentences = [" ".join(r.choice(vocabulary[level if r.random() < 0.8 else max(1, min(5, level + r.choice([-1, 1])))].split()) for _ in range(8)) for _ in range(8)]
        out.append((i, ". ".join(sentences) + ".", "web", level))
    return out


def test_levels(spark):
    data = graded(random.Random(4), 250)
    more = [(1000, "short text", "web", 1), (1001, "word " * 50, "xlsx", 1), (1002, None, "web", 1), (1003, "", "web", 1), (1004, "\n".join(["box cup red is on the it"] * 20), None, 1), (1005, "слово " * 30_000, "web", 1)]
    docs = spark.createDataFrame([x[:3] for x in data + more], "doc_id long, text string, source string").withColumn("reading_level", F.lit("clash"))
    labels = spark.createDataFrame([(i, level, "ra") for i, _, _, level in data[:150]] + [(0, 2, "rb"), (None, 3, "ra"), (7, None, "ra"), (8, 9, "ra"), (99_999, 3, "ra")], "doc_id long, reading_level long, rater string")
    got = {r.doc_id: r.reading_level for r in reading.levels(docs, labels).collect()}
    held = data[150:]
    assert np.mean([got[i] == level for i, _, _, level in held]) >= 0.9
    assert got[1004] == 1 and 1005 in got and not {1000, 1001, 1002, 1003} & set(got)
    assert reading.levels(docs, labels.limit(0)).count() == 0 and reading.levels(docs.limit(0), labels).count() == 0


def test_held_out_grades():
    """On the graded documents at hand: most held-out ones get a grade that a rater gave, all of them are close."""
    docs = {d: (t, s) for d, t, s in zip(*(pq.read_table("/root/testdata/sf0.1/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text", "source")))}
    labels = pq.read_table("/root/testdata/sf0.1/reading_labels.parquet").to_pylist()
    grades = defaultdict(list)
    for x in labels:
        t, s = docs[x["doc_id"]]
        if t and s != "xlsx" and len(t.split()) >= 40:
            grades[t].append(x["reading_level"])
    texts = sorted(grades)
    random.Random(1).shuffle(texts)
    train, test = texts[: len(texts) * 3 // 4], texts[len(texts) * 3 // 4 :]
    targets = np.array([[grades[t].count(k + 1) / len(grades[t]) for k in range(5)] for t in train])
    model = reading.Model(train, targets, np.arange(len(train)) % 2)
    level = model.distributions(test).argmax(axis=1) + 1
    assert np.mean([x in grades[t] for x, t in zip(level, test)]) >= 0.85
    assert np.mean([min(abs(x - g) for g in grades[t]) <= 1 for x, t in zip(level, test)]) >= 0.97

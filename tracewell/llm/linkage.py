"""Variant spellings of people's and organisations' names.

Names are reduced to sorted words in comparable form, and equal keys are one. The distinct words of a registry meet
in places that all words alike have in common (letters left out, or the rarest pairs of letters); two names meet where one
of them, with a word replaced by one like it, equals the other or the other with another word replaced. So names that
share a frequent word are never held against each other, and neither order nor role of the words matters. Names that
meet are verified by Monge-Elkan similarity over all their words and clustered by star clustering, where the best
supported key is a centre and its neighbours are its satellites. Rows with an equal account are one person or
organisation; rows of one name are one unless their accounts of one kind differ.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import names
from tracewell.operators.ranking import positions
from tracewell.session import checkpoint

#: Least likeness of two words (edits over length, a swap is one edit), and least Monge-Elkan similarity of two names.
LEAST_WORD, LEAST_SIMILARITY = 0.775, 0.885
#: Author texts that stand for nobody.
PLACEHOLDERS = ("deleted account", "unknown", "hidden sender", "unknown author", "hidden user", "n/a", "-", "?")

PAIR = T.StructType([T.StructField("letter", T.StringType()), T.StructField("rest", T.StringType())])
PAIR_ARROW = pa.struct([("letter", pa.string()), ("rest", pa.string())])
PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("first", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("account", T.StringType())])
MADE = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("letters", T.ArrayType(PAIR))])
SKETCH = T.StructType([T.StructField("letters", T.LongType()), T.StructField("places", T.ArrayType(T.LongType()))])
RANGE = T.ArrayType(T.StructType([T.StructField("shape", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("base", T.LongType())]))


@F.arrow_udf(PARSED)
def _parse(texts: pa.Array) -> pa.Array:
    rows = [(*names.parse(x), names.account(x) if x else None) for x in texts.to_pylist()]
    kind = pa.struct([("kind", pa.string()), ("first", pa.string()), ("words", pa.list_(pa.string())), ("account", pa.string())])
    return pa.array([dict(zip(("kind", "first", "words", "account"), r)) for r in rows], type=kind)


@F.arrow_udf(T.StringType())
def _account(texts: pa.Array) -> pa.Array:
    return pa.array([names.account(x) if x else None for x in texts.to_pylist()], type=pa.string())


@F.arrow_udf(T.ArrayType(PAIR))
def _letters(keys: pa.Array) -> pa.Array:
    return pa.array([[{"letter": a, "rest": b} for a, b in names.letters(x.split("|"))] for x in keys.to_pylist()], type=pa.list_(PAIR_ARROW))


@F.arrow_udf(MADE)
def _made(accounts: pa.Array) -> pa.Array:
    rows = [names.account_names(x) if x else ([], []) for x in accounts.to_pylist()]
    return pa.array([{"keys": k, "letters": [{"letter": a, "rest": b} for a, b in p]} for k, p in rows], type=pa.struct([("keys", pa.list_(pa.string())), ("letters", pa.list_(PAIR_ARROW))]))


@F.arrow_udf(SKETCH)
def _sketch(words: pa.Array) -> pa.Array:
    rows = [{"letters": names.letter_set(x), "places": names.meeting_places(x, 1 - LEAST_WORD)} for x in words.to_pylist()]
    return pa.array(rows, type=pa.struct([("letters", pa.int64()), ("places", pa.list_(pa.int64()))]))


@F.arrow_udf(T.DoubleType())
def _likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([names.likeness(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], type=pa.float64())


@F.arrow_udf(T.DoubleType())
def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Monge-Elkan similarity of two keys."""
    return pa.array([names.monge_elkan(x.split("|"), y.split("|")) for x, y in zip(a.to_pylist(), b.to_pylist())], type=pa.float64())


@F.arrow_udf(T.BooleanType())
def _may_hold(account: pa.Array, held: pa.Array) -> pa.Array:
    """Whether a holder of the accounts ``held`` may also hold one that is not registered: no second mail address, and
    the numbers of one of them."""
    out = []
    for a, h in zip(account.to_pylist(), held.to_pylist()):
        own = [(x["type"], x["account"]) for x in h or []]
        numbers = {names.digits(x) for t, x in own if t != "site"}
        out.append(not ("@" in a and any(t == "email" for t, _ in own)) and (not numbers or names.digits(a) in numbers))
    return pa.array(out, type=pa.bool_())


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, likeness): all different words of (word, listed) that are alike, at least one of them listed.

    Words meet in one of their :func:`names.meeting_places`. What is left out before the likeness is computed cannot reach ``LEAST_WORD``: a difference in
    length is an edit for each letter, an edit changes the set of letters in two at most, and a swap is two edits at most
    where swaps are none. Each pair comes once, the smaller word first.
    """
    sketched = checkpoint(words.select("word", "listed", F.length("word").alias("n"), _sketch(F.col("word")).alias("_s")))
    a = sketched.select("word", "listed", "n", "_s.letters", F.explode("_s.places").alias("_h"))
    b = a.withColumnsRenamed({"word": "near", "listed": "_listed", "n": "_n", "letters": "_letters"})
    edits = F.floor((1 - LEAST_WORD) * F.greatest("n", "_n") + 1e-9)
    close = (F.abs(F.col("n") - F.col("_n")) <= edits) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("_letters"))) <= 2 * edits)
    met = a.join(b.hint("merge"), "_h").where((F.col("word") < F.col("near")) & close & (F.col("listed") | F.col("_listed")))
    met = checkpoint(met.where(F.levenshtein("word", "near") <= 2 * edits).select("word", "near").distinct())
    return met.withColumn("likeness", _likeness(F.col("word"), F.col("near"))).where(F.col("likeness") >= LEAST_WORD)


def _words(keys: DataFrame) -> DataFrame:
    """(word, listed) of keys (key, words, listed): plain words, and whether any listed name has them."""
    each = keys.select("listed", F.explode("words").alias("word")).where(~F.left("word", F.lit(1)).isin(names.AS_GIVEN, names.AS_BUSINESS))
    return each.groupBy("word").agg(F.max("listed").alias("listed"))


def _patched(keys: DataFrame, near: DataFrame) -> DataFrame:
    """(key, listed, patch): each key as it is, and with each of its words replaced by each word that is near."""
    each = keys.select("key", "listed", "words", F.posexplode("words").alias("_i", "word"))
    other = F.concat(F.slice("words", 1, F.col("_i")), F.array("near"), F.slice("words", F.col("_i") + 2, F.size("words")))
    hit = each.join(near, "word").select("key", "listed", F.array_join(F.array_sort(other), "|").alias("patch"))
    return keys.select("key", "listed", F.col("key").alias("patch")).unionByName(hit)


def near_keys(keys: DataFrame, near: DataFrame) -> DataFrame:
    """(key, near, similarity): different keys (key, words, listed) that are alike, near of them listed.

    near (word, near) holds the words that are alike in both directions. Names that differ in one word, or in two, meet: at
    most one word of each is replaced.
    """
    a = _patched(keys, near)
    b = a.where("listed").select(F.col("key").alias("near"), "patch")
    met = checkpoint(a.join(b, "patch").where("key <> near").select("key", "near").distinct())
    return met.withColumn("similarity", _similarity(F.col("key"), F.col("near"))).where(F.col("similarity") >= LEAST_SIMILARITY)


def stars(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, centre) by star clustering of keys (key, weight) with edges (key, near) in both directions.

    In each round a free key without a better free neighbour (weight, then hash, then key) becomes a centre and its free
    neighbours join the best centre beside them. Every key ends up in exactly one star. Equal weights are ordered by
    hash, so that rounds grow with the logarithm of a chain of equals.
    """
    edges = checkpoint(edges.select("key", "near"))
    rank = F.struct("weight", F.xxhash64("key").alias("h"), "key").alias("r")
    ranked = keys.select("key", rank)
    free = checkpoint(ranked.join(edges.select("key").distinct(), "key", "left_semi"))
    done = [keys.join(free.select("key"), "key", "left_anti").select("key", F.col("key").alias("centre"))]
    while not edges.isEmpty():
        other = free.select(F.col("key").alias("near"), F.col("r").alias("_r"))
        best = edges.join(other, "near").groupBy("key").agg(F.max("_r").alias("_best"))
        centres = free.join(best, "key", "left").where("_best is null or r > _best").select("key", "r")
        beside = edges.join(centres.select(F.col("key").alias("near"), F.col("r").alias("_r")), "near").groupBy("key").agg(F.max("_r").alias("_r"))
        step = centres.select("key", F.col("key").alias("centre")).unionByName(beside.select("key", F.col("_r.key").alias("centre")))
        step = checkpoint(step)
        done.append(step)
        free = free.join(step, "key", "left_anti")
        edges = checkpoint(edges.join(step.select("key"), "key", "left_anti").join(step.select(F.col("key").alias("near")), "near", "left_anti"))
    done.append(free.join(done[-1], "key", "left_anti").select("key", F.col("key").alias("centre")) if len(done) > 1 else free.select("key", F.col("key").alias("centre")))
    out = done[0]
    for step in done[1:]:
        out = out.unionByName(step)
    return checkpoint(out)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of links (node, at): nodes that meet somewhere, directly or through others, have one label.

    The label is the smallest node of the component. Smallest labels spread over all links of a place, then each node
    takes the label of its label, so rounds do not grow with the diameter but with its logarithm.
    """
    shared = links.distinct().groupBy("at").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a <> _b").select("at")
    links = checkpoint(links.distinct().join(shared, "at", "left_semi"))
    state = links.select("node").distinct().withColumn("label", F.col("node"))
    if links.isEmpty():
        return state
    while True:
        low = links.join(state, "node").groupBy("at").agg(F.min("label").alias("_low"))
        new = links.join(low, "at").groupBy("node").agg(F.min("_low").alias("_low")).join(state, "node")
        jump = new.select(F.col("node").alias("_at"), F.col("_low").alias("_far"))
        new = new.join(jump, F.col("_low") == F.col("_at"), "left").select("node", F.least("_low", F.coalesce("_far", "_low")).alias("_new"), "label")
        new = checkpoint(new)
        state = new.select("node", F.col("_new").alias("label"))
        if new.where("_new < label").isEmpty():
            return state


def registry(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spellings, accounts): (id, main, kind, first, words, key) of each name, (id, type, account) of each account."""
    rows = people.where("id is not null").select("id", "display", "aliases", "handles")
    spelled = rows.select("id", F.lit(True).alias("main"), F.col("display").alias("name")).unionByName(
        rows.select("id", F.lit(False).alias("main"), F.explode("aliases").alias("name"))
    )
    parsed = spelled.where("name is not null").withColumn("_p", _parse(F.col("name"))).select("id", "main", "_p.kind", "_p.first", "_p.words")
    spelled = checkpoint(parsed.where("kind <> 'none'").withColumn("key", F.array_join("words", "|")).distinct())
    held = rows.select("id", F.explode("handles").alias("type", "name")).where("name is not null")
    held = held.withColumn("account", _account(F.col("name"))).where("account <> ''").select("id", "type", "account").distinct()
    return spelled, checkpoint(held)


def _settle(counts: list[tuple[str, int]]) -> list[tuple[str, int, int, int]]:
    """(shape, low, high, base): which units of one name share a cluster, from how many have each shape.

    A shape is the set of account kinds that a unit has. Units of different people share none of their accounts, so two
    fit together only if they have no kind in common. Those with most kinds come first; each other takes its place in a
    cluster that lacks all of its kinds, the fullest first, or starts one. Units ``low`` to ``high`` of a shape go to
    clusters ``base``, ``base`` + 1, ... The work depends on the number of shapes only.
    """
    groups: list[tuple[frozenset[str], int, int]] = []  # kinds, first cluster, how many
    out, total = [], 0
    for shape, n in sorted(counts, key=lambda x: (-len(x[0].split(",")) if x[0] else 0, x[0])):
        own, at = frozenset(shape.split(",")) if shape else frozenset(), 1
        left: list[tuple[frozenset[str], int, int]] = []
        for kinds, first, many in sorted(groups, key=lambda g: (-len(g[0]), g[1])):
            k = min(n - at + 1, many) if not kinds & own else 0
            if k:
                out.append((shape, at, at + k - 1, first))
                left.append((kinds | own, first, k))
                at += k
            if many > k:
                left.append((kinds, first + k, many - k))
        if at <= n:
            out.append((shape, at, n, total))
            left.append((own, total, n - at + 1))
            total += n - at + 1
        groups = left
    return out


@F.arrow_udf(RANGE)
def _ranges(counts: pa.Array) -> pa.Array:
    rows = [[dict(zip(("shape", "low", "high", "base"), r)) for r in _settle([(x["shape"], x["n"]) for x in c])] for c in counts.to_pylist()]
    return pa.array(rows, type=pa.list_(pa.struct([("shape", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("base", pa.int64())])))


def _clusters(homes: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, cluster) of rows (id, centre): one person or organisation each.

    Rows that have an account in common, directly or through others, are one unit; rows of a name without any account are
    one. Units of a name are then settled (see :func:`_settle`), however many they are.
    """
    place = F.concat_ws("\0", "type", "account")
    joined = components(accounts.select(F.col("id").alias("node"), place.alias("at"))).withColumnsRenamed({"node": "id", "label": "_label"})
    held = accounts.select("id").distinct().join(joined, "id", "left").select("id", F.coalesce("_label", "id").alias("_label"))
    rows = homes.join(held, "id", "left").select("id", "centre", F.coalesce("_label", F.concat(F.lit("\0"), F.col("centre"))).alias("unit"))
    rows = checkpoint(rows)
    kinds = accounts.join(held, "id").groupBy(F.col("_label").alias("unit")).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("shape"))
    units = rows.select("unit", "centre").distinct()
    several = units.groupBy("centre").agg(F.count("*").alias("n")).where("n > 1").select("centre")
    units = units.join(several, "centre", "left_semi").join(kinds, "unit", "left").withColumn("shape", F.coalesce("shape", F.lit("")))
    placed = checkpoint(positions(units, ["centre", "shape"], ["unit"], "number"))
    counts = placed.groupBy("centre", "shape").agg(F.count("*").alias("n")).groupBy("centre").agg(F.collect_list(F.struct("shape", "n")).alias("counts"))
    ranges = counts.select(F.col("centre").alias("_c"), F.inline(_ranges(F.col("counts")))).withColumnRenamed("shape", "_s")
    at = placed.join(ranges, (F.col("centre") == F.col("_c")) & (F.col("shape") == F.col("_s")) & F.col("number").between(F.col("low"), F.col("high")))
    at = at.select("unit", "centre", F.concat_ws("#", "centre", (F.col("base") + F.col("number") - F.col("low")).cast("string")).alias("at"))
    rows = checkpoint(rows.join(at, ["unit", "centre"], "left").withColumn("at", F.coalesce("at", F.concat_ws("#", "centre", F.lit("0")))))
    # a unit whose rows have different names holds the clusters of these together
    whole = components(rows.select(F.col("at").alias("node"), F.col("unit").alias("at"))).withColumnsRenamed({"node": "at", "label": "_whole"})
    return checkpoint(rows.join(whole, "at", "left").select("id", F.coalesce("_whole", "at").alias("cluster")))


def _shortened(short: DataFrame, lettered: DataFrame, near: DataFrame, own: str) -> DataFrame:
    """(own, centre) of short forms (own, letter, rest): full names (letter, rest, centre) they may stand for.

    The rest is taken as it is written, or else like the rests it is most like.
    """
    exact = short.select(own, "letter", "rest", F.lit(1.0).alias("likeness"))
    like = short.join(near, F.col("rest") == F.col("word")).select(own, "letter", F.col("near").alias("rest"), "likeness")
    met = exact.unionByName(like).join(lettered, ["letter", "rest"])
    best = met.groupBy(own).agg(F.max("likeness").alias("_best"))
    return met.join(best, own).where("likeness = _best").select(own, "centre").distinct()


def parse_authors(authors: DataFrame) -> DataFrame:
    """(author, kind, first, words, key, account) of the distinct texts of (author) that may stand for somebody."""
    texts = authors.where("author is not null").select("author").distinct()
    texts = texts.where(~F.lower(F.trim("author")).isin(*PLACEHOLDERS)).withColumn("_p", _parse(F.col("author")))
    return checkpoint(texts.select("author", "_p.kind", "_p.first", "_p.words", "_p.account").withColumn("key", F.array_join("words", "|")))


class Names:
    """The names of a registry, and of authors if there are any, with what they are like."""

    def __init__(self, people: DataFrame, texts: DataFrame | None = None) -> None:
        """people (id, display, aliases, handles); texts of :func:`parse_authors`."""
        self.spelled, self.accounts = registry(people)
        weight = F.sum(F.when(F.col("main"), 3).otherwise(1)).alias("weight")
        all_names = self.spelled.select("kind", "key", "words", "main", F.lit(True).alias("listed"))
        if texts is not None:
            all_names = all_names.unionByName(texts.select("kind", "key", "words", F.lit(False).alias("main"), F.lit(False).alias("listed")))
        rows = all_names.where("kind <> 'none'").groupBy("kind", "key", "words").agg(weight, F.max("listed").alias("listed"))
        rows = checkpoint(rows)
        keys = rows.where("kind = 'full'")
        self.letters = checkpoint(keys.where("listed").select("key", F.inline(_letters(F.col("key")))))
        rests = self.letters.select(F.col("rest").alias("word"), F.lit(True).alias("listed")).unionByName(rows.where("kind = 'initial'").select(F.col("key").alias("word"), F.lit(False).alias("listed")))
        words = _words(keys).unionByName(rests).groupBy("word").agg(F.max("listed").alias("listed"))
        near = near_words(words)
        self.near = checkpoint(near.unionByName(near.select(F.col("near").alias("word"), F.col("word").alias("near"), "likeness")))
        self.alike = checkpoint(near_keys(keys, self.near))
        self.keys = keys.where("listed").select("key", "words", "weight")
        edges = self.alike.join(self.keys.select("key"), "key", "left_semi")
        self.centres = stars(self.keys, edges)
        self.lettered = checkpoint(self.letters.join(self.centres, "key").select("letter", "rest", "centre").distinct())


def entities(people: DataFrame, known: Names | None = None) -> tuple[DataFrame, Names]:
    """((id, cluster), names): each row of people with its person or organisation.

    Repeated rows of an id count once. Rows without any usable name stand alone unless they share an account.
    """
    known = known or Names(people)
    full = known.spelled.where("kind = 'full'")
    votes = full.join(known.centres, "key").groupBy("id", "centre").agg(F.sum(F.when(F.col("main"), 3).otherwise(1)).alias("_n"))
    own = votes.groupBy("id").agg(F.max_by("centre", F.struct("_n", "centre")).alias("centre"))
    short = known.spelled.where("kind = 'initial'").join(own.select("id"), "id", "left_anti").select("id", F.col("first").alias("letter"), F.col("key").alias("rest"))
    fits = _shortened(short, known.lettered, known.near, "id").groupBy("id").agg(F.min("centre").alias("centre"), F.max("centre").alias("_other"))
    own = own.unionByName(fits.where("centre = _other").select("id", "centre"))
    ids = people.where("id is not null").select("id").distinct()
    homes = ids.join(own, "id", "left").select("id", F.coalesce("centre", F.concat(F.lit("#"), F.col("id"))).alias("centre"))
    return _clusters(homes, known.accounts), known


def link_people(members: DataFrame) -> DataFrame:
    """(left_key, right_key): all pairs of a cluster, the smaller id first."""
    other = members.select(F.col("id").alias("right_key"), "cluster")
    return members.select(F.col("id").alias("left_key"), "cluster").join(other, "cluster").where("left_key < right_key").select("left_key", "right_key")


def link_authors(texts: DataFrame, members: DataFrame, known: Names) -> DataFrame:
    """(author, cluster): each distinct author text of :func:`parse_authors` with the persons or organisations it stands for.

    An author that is an account of the registry is that account's holder; an account that is not registered goes to those
    whose name it is made of, if it does not differ from the accounts they have. Other names go to the star of their key, or
    of the most similar key; a first letter with a last name to those it fits. Unknown names, placeholders, bare first
    names, blanks and null have no link.
    """
    by_account = texts.join(known.accounts.select("account", "id"), "account").join(members, "id").select("author", "cluster")
    rest = checkpoint(texts.join(by_account.select("author").distinct(), "author", "left_anti"))
    centres = known.centres
    home = known.spelled.where("kind = 'full'").join(centres, "key").select("id", "centre").distinct().join(members, "id").select("centre", "cluster").distinct()
    fuzzy = known.alike.join(centres.select("key"), "key", "left_anti").join(centres.withColumnRenamed("key", "near"), "near")
    fuzzy = fuzzy.groupBy("key").agg(F.max_by("centre", F.struct("similarity", "centre")).alias("centre"))
    named = rest.where("kind = 'full'").join(centres.unionByName(fuzzy), "key").select("author", "centre")
    letters = rest.where("kind = 'initial'").select("author", F.col("first").alias("letter"), F.col("key").alias("rest"))
    meant = named.unionByName(_shortened(letters, known.lettered, known.near, "author")).select("author", F.lit(None).cast("string").alias("account"), "centre")
    made = checkpoint(rest.where("kind = 'none'").select("author", "account", _made(F.col("account")).alias("_m")))
    whole = made.select("author", "account", F.explode("_m.keys").alias("key")).join(centres, "key").select("author", "account", "centre")
    parts = made.select("author", "account", F.inline("_m.letters")).join(known.lettered, ["letter", "rest"]).select("author", "account", "centre")
    meant = checkpoint(meant.unionByName(whole).unionByName(parts).join(home, "centre").select("author", "account", "cluster").distinct())
    asked = meant.where("account is not null")
    holds = known.accounts.join(members, "id").join(asked.select("cluster").distinct(), "cluster", "left_semi").groupBy("cluster").agg(F.collect_set(F.struct("type", "account")).alias("held"))
    asked = asked.join(holds, "cluster", "left").where(_may_hold(F.col("account"), F.col("held"))).select("author", "cluster")
    return by_account.unionByName(meant.where("account is null").select("author", "cluster")).unionByName(asked).distinct()


def links(people: DataFrame, messages: DataFrame) -> DataFrame:
    """(kind, left_key, right_key): pairs of rows of people, and authors with the rows they stand for."""
    texts = parse_authors(messages.select("author"))
    members, known = entities(people, Names(people, texts))
    pairs = link_people(members).select(F.lit("people").alias("kind"), "left_key", "right_key")
    authors = link_authors(texts, members, known).join(members, "cluster").select(F.lit("author").alias("kind"), F.col("author").alias("left_key"), F.col("id").alias("right_key"))
    return pairs.unionByName(authors)

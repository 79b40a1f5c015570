"""Personal information inside free text: information-theoretic sanitisation.

Addresses, places and most numbers have a form of their own and are found by it. Numbers whose form is that of things
too are judged by the word before them: how many of the numbers that follow it in the corpus have a person's form.
Names have no form. Which words are given names is learned from the registry of people (a given name stands beside many
words that stand beside few) and then from the texts (it stands before many of the registry's surnames). Which terms
are surnames is estimated from the whole corpus: for each term, how often it stands beside a given name or an initial (out of all its
places), and how much it tells about which one. A surname stands beside few given names and so reveals a person; a verb
or a noun stands beside all of them and reveals nobody. The disclosure of a term is the divergence of its partners'
distribution from that of all partners, in bits; terms above the thresholds are removed together with the given name,
nickname or initial beside them. A surname of very many people tells little about which, but unlike a verb it has hardly
any place but beside given names, and follows them; such terms are removed too.

One scan finds everything but the decision on names: it writes places, candidates and counts to the shared folder. The
decision is a join of candidates with one row per term, so nothing is broadcast that grows with the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.names import BUSINESS, DECORATION, GIVEN, LEGAL
from tracewell.session import checkpoint

#: Least share of a term's places beside a given name or initial, and least disclosure in bits.
LEAST_SHARE, LEAST_BITS = 0.45, 2.75
#: With so many places beside a given name that is written out, and this share of all its places with a capital, a term needs no least share:
#: it is a name that many call by itself.
MANY_PLACES, CAPITAL_SHARE = 20, 0.9
#: A given name stands beside so many different words that stand beside fewer, and before surnames in this share.
LEAST_PARTNERS, BEFORE_SHARE = 5, 0.5
#: More given names than that are refused: they are sent to every task.
MOST_GIVEN = 50_000
#: Of the numbers that follow a word, this share must have a person's form for others to count as a person's.
LABEL_SHARE = 0.3
#: A term that tells less must stand beside names in this share of its places, and behind them in this share.
COMMON_SHARE, COMMON_BEHIND = 0.9, 0.4
#: Marks the count of places behind a given name or initial among the partners.
BEHIND = ">"
#: Marks the count of places with a capital, and terms that are words before numbers.
CAPITAL, LABEL = "^", "#"
#: Titles that stand before surnames.
TITLES = frozenset("mr mrs ms miss dr doctor prof professor sir madam herr frau kollege kollegin doktor господин госпожа товарищ коллега доктор".split())
#: Counts are passed on whenever a task holds so many different terms.
TERMS_AT_ONCE = 200_000
#: Stands between two texts of a batch; no pattern matches it.
BREAK = "\n\0\n"
KINDS = ("email", "phone", "identity", "address", "name")
#: Numbers that may be a person's or a thing's, and all others of five digits and more.
UNSURE = {"identity": re.compile(r"(?<![\w.,+#-])(?:\d{12}|[A-Z]{1,2}\d{6,9})(?![\w-]|[.,]\d)"), "phone": re.compile(r"(?<![\w.,+#-])\d{10}(?![\w-]|[.,]\d)")}
NUMBER = re.compile(r"(?<!\w)\d{5,}(?!\w)")
BEFORE_NUMBER = re.compile(r"([^\W\d_]+)[.:№#]? ?$")

AT = r"(?:[@＠]| [@＠] | ?[(\[{]at[)\]}] ?| собака )"
DOT = r"(?:\.| ?[(\[{](?:dot|punkt|точка)[)\]}] ?)"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9_](?:[\w.+-]*[\w+-])?(?:{AT}{LABEL}(?:{DOT}{LABEL})*{DOT}[A-Za-z]{{2,}}| at {LABEL}(?: dot {LABEL})* dot [A-Za-z]{{2,}})(?![\w@])"
)
URL = re.compile(r"https?://[^\s\0]+")
MENTION = re.compile(r"(?<!\w)@\w+")
PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}[ -]?\(?\d{1,5}\)?(?:[ .-]?\d{1,6}){1,5}|00[1-9]\d{0,2}(?:[ -]?\d{2,6}){2,4}"
    r"|8 ?\(\d{3}\) ?\d{3}[ -]\d{2}[ -]\d{2}|\(\d{2,5}\) ?\d{3,4}[ -]\d{3,4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|0\d{2,4}[ /-]\d{3,4} \d{3,4})(?![\w-]|\.\d)"
)
IDENTITY = re.compile(
    r"(?<![\w.,+#-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2} \d{2} \d{6}|\d{3}-\d{3}-\d{3} \d{2}|\d{3}-\d{2}-\d{4}"
    r"|[A-Z]\d[A-Z]\d{3}[A-Z]\d{2})(?![\w-]|[.,]\d)"
)
UP = r"[A-ZÄÖÜА-ЯЁ][\w'’-]*"
TOWN = r"(?:\d{4,6} )?[A-ZÄÖÜ][a-zäöüß]+(?![\w.+-]*@)(?! ?[@(\[])(?![\w.])"
ADDRESS = re.compile(
    # number first, and a named court with its number
    rf"(?<![\w.,])(?:(?:Flat|Apt|Apartment|Unit)\.? \d+[A-Za-z]?, )?\d{{1,5}}[A-Za-z]? (?:{UP} ){{1,3}}(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Drive|Way|Place|Square|Close|Terrace|Gardens|Mews|Crescent|Boulevard|Blvd|Grove|Quay|Parade)\b\.?(?:, (?:Flat|Apt|Apartment|Unit)\.? \d+[A-Za-z]?)?(?:, {TOWN})?"
    rf"|(?<![\w.,])(?:(?:flat|apt) \d+, )?\d{{1,5}}[a-z]? [a-z]{{4,}} (?:street|road|avenue)\b(?:, (?:flat|apt) \d+)?"
    rf"|(?<!\w)(?:{UP} )Court \d{{1,5}}[A-Za-z]?(?:, {TOWN})?(?!\w)"
    # Russian: street, house, flat
    r"|(?<!\w)(?:\d{6}, )?(?:г\. ?[А-ЯЁ][а-яё-]+, )?(?:(?:ул|пр|просп|пер|пл|наб|ш)\. ?|(?:[Уу]лица|[Пп]роспект|[Пп]ереулок|[Пп]лощадь|[Нн]абережная|[Шш]оссе) )[А-ЯЁ][а-яё-]+(?: [А-ЯЁ][а-яё-]+)?,? (?:д\. ?|дом )?\d+[а-я]?(?:[-/]\d+)?(?:, ?(?:кв\. ?|квартира )\d+)?(?:, (?:\d{6} )?г\. ?[А-ЯЁ][а-яё-]+)?(?!\w)"
    r"|(?<!\w)(?:\d{6}, )?(?:г\. ?[А-ЯЁ][а-яё-]+, )?[А-ЯЁ][а-яё-]+ (?:улица|проспект|переулок|площадь|набережная|шоссе),? (?:д\. ?|дом )?\d+[а-я]?(?:[-/]\d+)?(?:, ?(?:кв\. ?|квартира )\d+)?(?!\w)"
    # Romance: street, number, town
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Via|Viale|Piazza|Rua|Rue|Carrer)(?: (?:de|del|della|la|las|los|di|du|des|do|da|dos))* (?:{UP} ){{0,2}}{UP},? \d{{1,5}}[A-Za-z]?(?:, {TOWN})?(?!\w)"
    rf"|(?<![\w.,])\d{{1,5}}[A-Za-z]?,? (?:[Rr]ue|[Aa]venue)(?: (?:de|la|du|des))+ (?:{UP} ?){{1,3}}(?:, {TOWN})?(?!\w)"
    # German: street and number, postcode and town
    rf"|(?<!\w)(?:\d{{5}} {UP}, )?(?:[A-ZÄÖÜ][a-zäöüß-]+(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|ufer|damm)|(?:Am|An der|Im|Zum|Zur) [A-ZÄÖÜ][a-zäöüß-]+) \d{{1,4}}[a-z]?(?:, \d{{5}} [A-ZÄÖÜ][a-zäöüß]+)?(?!\w)"
)

#: Given names and nicknames in lower case; those that are also English words count only with a capital letter.
ALSO_WORDS = frozenset("will pat bill rob gene kit bob jo nick mike ted leo alex greg rita liz bella theo chris gene max".split())
CANONICAL = {v: k for k, vs in GIVEN.items() for v in [k, *vs.split()]}
LETTERS = np.array([chr(c).isalpha() for c in range(0x10000)])
UPPER = np.array([chr(c).isupper() for c in range(0x10000)])
SPACES = np.zeros(0x10000, dtype=bool)
SPACES[[0x20, 0xA0]] = True


class _Terms(dict):
    """Word to number, with what is needed of each word in arrays."""

    def __init__(self, given: frozenset[str]) -> None:
        super().__init__()
        self.given = given
        self.lower: list[str] = []
        self.partner: list[str | None] = []
        self.flags: list[int] = []
        self.table = np.zeros(0, dtype=np.int64)

    def __missing__(self, word: str) -> int:
        low = word.lower()
        number = self[word] = len(self.lower)
        capital = word[0].isupper()
        given = self._given(low, capital)
        self.lower.append(low)
        single = len(word) == 1 and capital
        self.partner.append(given or (word if single else None))
        self.flags.append((1 if given else 0) | (2 if single else 0) | (4 if (len(word) >= 4 or len(word) > 1 and capital and word[1:].islower()) and not given and low not in CANONICAL else 0) | (8 if capital else 0))
        return number

    def _given(self, low: str, capital: bool) -> str | None:
        """The given name a word stands for; those that were learned, and double ones, only with a capital."""
        if not capital:
            return CANONICAL.get(low) if low not in ALSO_WORDS else None
        if low in CANONICAL or low in self.given:
            return CANONICAL.get(low, low)
        parts = low.split("-")
        return CANONICAL.get(parts[0], parts[0]) if len(parts) > 1 and all(p in CANONICAL or p in self.given for p in parts) else None

    def of(self, ids: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.flags):
            self.table = np.array(self.flags, dtype=np.int64)
        return self.table[ids]


def _spans(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text)]


def _free(spans: list[tuple[int, int]], taken: np.ndarray) -> list[tuple[int, int]]:
    """Spans that touch nothing taken; they are then taken."""
    out = []
    for a, b in spans:
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((a, b))
    return out


class Scan:
    """Finds places, candidates and counts in batches of texts; ``given`` are given names in lower case."""

    def __init__(self, given: frozenset[str] = frozenset()) -> None:
        self.given, self.terms = given, _Terms(given)
        self.total: Counter[str] = Counter()
        self.beside: Counter[tuple[str, str]] = Counter()

    def batch(self, texts: list[str]) -> tuple[list[tuple[int, str, int, int]], list[tuple[int, str, int, int, str]]]:
        """([(text, kind, start, end)], [(text, kind, start, end, term)]) and, in the counters, the terms."""
        s = BREAK.join(texts)
        begins = np.concatenate([[0], np.cumsum([len(t) + len(BREAK) for t in texts])])[:-1]
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.minimum(codes, 0xFFFF)
        taken = np.zeros(len(s) + 1, dtype=bool)
        places, doubtful = [], []
        for kind, pattern in (("email", EMAIL), ("", URL), ("address", ADDRESS), ("identity", IDENTITY), ("phone", PHONE), ("", MENTION)):
            found = _free(_spans(pattern, s), taken)
            if kind == "identity":  # before telephone numbers, which have fewer digits
                doubtful = _free(_spans(UNSURE[kind], s), taken)
            if kind == "phone":
                found = [(a, b) for a, b in found if 7 <= sum(c.isdigit() for c in s[a:b]) <= 15]
            if kind and found:
                at = np.searchsorted(begins, [a for a, _ in found], side="right") - 1
                places += [(t, kind, a - int(begins[t]), b - int(begins[t])) for t, (a, b) in zip(at.tolist(), found)]
        unsure = self._numbers(s, places, doubtful, begins, taken)
        letter = LETTERS[codes] & ~taken[:-1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
        starts, ends = _whole_words(edges[::2], edges[1::2], codes)
        ids = np.array([self.terms[s[a:b]] for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.int64)
        if not len(ids):
            return places, unsure
        lower, partner = self.terms.lower, self.terms.partner
        counts = np.bincount(ids, minlength=len(lower))
        f = self.terms.of(np.arange(len(lower)))
        for i in np.flatnonzero(counts).tolist():
            self.total[lower[i]] += int(counts[i])
            if f[i] & 8:
                self.beside[lower[i], CAPITAL] += int(counts[i])
        f = f[ids]
        given, single, term, capital = (f & 1) > 0, (f & 2) > 0, (f & 4) > 0, (f & 8) > 0
        padded = np.concatenate([codes, [0, 0, 0]])
        after, gap = padded[ends], np.concatenate([starts[1:] - ends[:-1], [0]])
        second = padded[np.minimum(ends + 1, len(padded) - 1)]
        spaced = (gap == 1) & SPACES[after]
        comma = (gap == 2) & (after == ord(",")) & SPACES[second]
        dotted = ((gap == 2) & (after == ord(".")) & SPACES[second]) | ((gap == 1) & (after == ord(".")))
        left, right = slice(None, -1), slice(1, None)
        same = capital[left] == capital[right]
        candidates = []
        forms = (
            (given[left] & term[right] & spaced[left] & same, 0, 1, False),
            (term[left] & given[right] & spaced[left] & same, 1, 0, False),
            (single[left] & term[right] & dotted[left] & capital[right], 0, 1, False),
            (term[left] & single[right] & comma[left] & capital[left] & (after[right] == ord(".")), 1, 0, True),
            (term[left] & single[right] & spaced[left] & capital[left] & (after[right] == ord(".")), 1, 0, True),
            (term[left] & given[right] & comma[left] & capital[left] & capital[right], 1, 0, None),
        )
        for mask, p, q, dot in forms:
            for i in np.flatnonzero(mask).tolist():
                word = lower[ids[i + q]]
                if dot is not None:  # "word, Given" is more often a call than a name and counts for nothing
                    self.beside[word, partner[ids[i + p]]] += 1
                    if q:
                        self.beside[word, BEHIND] += 1
                candidates.append((int(starts[i]), int(ends[i + 1]) + (1 if dot else 0), word))
        # a second given name, or an initial, in the middle
        if len(ids) > 2:
            middle = (given[1:-1] & spaced[1:-1]) | (single[1:-1] & dotted[1:-1])
            for i in np.flatnonzero(given[:-2] & spaced[:-2] & middle & term[2:] & capital[:-2] & capital[2:]).tolist():
                candidates.append((int(starts[i]), int(ends[i + 2]), lower[ids[i + 2]]))
        at = np.searchsorted(begins, [a for a, _, _ in candidates], side="right") - 1
        return places, unsure + [(t, "name", a - int(begins[t]), b - int(begins[t]), w) for t, (a, b, w) in zip(at.tolist(), candidates)]

    def _numbers(self, s: str, places: list[tuple[int, str, int, int]], doubtful: list[tuple[int, int]], begins: np.ndarray, taken: np.ndarray) -> list[tuple[int, str, int, int, str]]:
        """Numbers that may be a person's, with the word before them; the words before all numbers are counted."""

        def label(a: int) -> str | None:
            m = BEFORE_NUMBER.search(s[max(0, a - 30) : a])
            return LABEL + m[1].lower() if m else None

        for t, kind, a, _ in places:
            if kind in UNSURE and (w := label(a + int(begins[t]))):
                self.beside[w, kind] += 1
        out = []
        for kind, spans in (("identity", doubtful), ("phone", _free(_spans(UNSURE["phone"], s), taken))):
            for a, b in spans:
                if w := label(a):
                    t = int(np.searchsorted(begins, a, side="right")) - 1
                    out.append((t, kind, a - int(begins[t]), b - int(begins[t]), w))
                    self.beside[w, "unsure"] += 1
        for a, _ in _free(_spans(NUMBER, s), taken):
            if w := label(a):
                self.beside[w, "number"] += 1
        return out

    def counts(self) -> Iterator[tuple[str, str | None, int]]:
        """(term, partner, n) of terms that stood beside a name, (term, null, n) of all; then they are forgotten."""
        for (w, g), n in self.beside.items():
            yield w, g, n
        for w, n in self.total.items():
            yield w, None, n
        self.total.clear()
        self.beside.clear()
        if len(self.terms) > 2 * TERMS_AT_ONCE:
            self.terms = _Terms(self.given)


def _whole_words(starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, joined where a hyphen or an apostrophe stands between two that begin with a capital."""
    if len(starts) < 2:
        return starts, ends
    between, long = codes[ends[:-1]], ends - starts > 1
    mark = ((between == ord("-")) & long[:-1]) | (between == ord("'")) | (between == ord("’"))
    joined = (starts[1:] - ends[:-1] == 1) & mark & UPPER[codes[starts[:-1]]] & UPPER[codes[starts[1:]]] & long[1:]
    return starts[np.concatenate([[True], ~joined])], ends[np.concatenate([~joined, [True]])]


SCHEMA = "tbl string, rec_id string, kind string, start_pos bigint, end_pos bigint, term string, n bigint"


def scan(texts: DataFrame, given: frozenset[str] = frozenset()) -> DataFrame:
    """Places (kind), candidates (kind with ``?``) and counts (kind ``#``; rec_id is the partner) of (tbl, rec_id, text)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Scan(given)
        for batch in batches:
            tbl, rec, text = (batch.column(i).to_pylist() for i in range(3))
            places, candidates = work.batch(text)
            out = [(tbl[t], rec[t], kind, a, b, None, None) for t, kind, a, b in places]
            out += [(tbl[t], rec[t], f"{kind}?", a, b, w, None) for t, kind, a, b, w in candidates]
            if len(work.total) > TERMS_AT_ONCE:
                out += [(None, g, "#", None, None, w, n) for w, g, n in work.counts()]
            yield rows(out)
        yield rows([(None, g, "#", None, None, w, n) for w, g, n in work.counts()])

    return texts.where("text is not null and text <> ''").select("tbl", "rec_id", "text").mapInArrow(run, SCHEMA)


def learned_given(people: DataFrame, texts: DataFrame) -> frozenset[str]:
    """Given names in lower case, learned from the names of people (display, aliases), then from (text).

    In the registry a given name stands beside at least ``LEAST_PARTNERS`` different words that themselves stand beside
    fewer; names with a legal form or a line of business teach nothing, nor do words that are mostly found in such. In the
    texts it stands, inside a sentence, before as many different surnames of the registry, and before surnames mostly.
    """
    none = F.array().cast("array<string>")
    spelled = people.select(F.explode(F.concat(F.array("display"), F.coalesce("aliases", none))).alias("name")).where("name is not null")
    words = F.filter(F.regexp_extract_all(F.lower(F.regexp_replace("name", DECORATION.pattern, " ")), F.lit(r"\p{L}[\p{L}'’-]*"), F.lit(0)), lambda w: F.length(w) > 1)
    firm = F.arrays_overlap("w", F.array(*map(F.lit, sorted(LEGAL | {x for k, v in BUSINESS.items() for x in (k, *v.split())}))))
    rows = spelled.select(F.array_sort(words).alias("w")).where("size(w) > 1").distinct().withColumn("firm", firm)
    each = rows.select("w", "firm", F.explode("w").alias("word"))
    pairs = each.where("not firm").select("word", F.array_join(F.array_remove("w", F.col("word")), " ").alias("rest")).distinct()
    spread = each.groupBy("word").agg(F.count_if("firm").alias("firms"), F.count_if(~F.col("firm")).alias("own"))
    degree = pairs.groupBy("word").agg(F.count("*").alias("n"))
    beside = pairs.join(degree.select(F.col("word").alias("rest"), F.col("n").alias("m")), "rest", "left").where(F.coalesce("m", F.lit(1)) < LEAST_PARTNERS)
    given = beside.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PARTNERS).join(spread, "word").where("firms * 10 <= own").select("word")
    given = checkpoint(given)
    surnames = degree.where(F.col("n") < LEAST_PARTNERS).select(F.col("word").alias("second")).join(given.withColumnRenamed("word", "second"), "second", "left_anti")
    inside = F.regexp_extract_all("text", F.lit(r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+ \p{Lu}[\p{L}'’-]+"), F.lit(0))
    met = texts.where("text is not null").select(F.explode(inside).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    met = met.select(F.lower(F.substring_index("x", " ", 1)).alias("word"), F.lower(F.substring_index("x", " ", -1)).alias("second"), "n").where(~F.col("word").isin(*sorted(TITLES)))
    before = met.join(surnames.withColumn("_s", F.lit(True)), "second", "left").groupBy("word").agg(
        F.count_distinct(F.when(F.col("_s"), F.col("second"))).alias("seconds"), F.sum(F.when(F.col("_s"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("all")
    )
    more = before.where((F.col("seconds") >= LEAST_PARTNERS) & (F.col("hits") >= BEFORE_SHARE * F.col("all"))).select("word")
    listed = given.unionByName(more).distinct().limit(MOST_GIVEN + 1).collect()
    if len(listed) > MOST_GIVEN:
        raise ValueError(f"more than {MOST_GIVEN} given names")
    return frozenset(r.word for r in listed)


def labels(found: DataFrame) -> DataFrame:
    """(term, kind): words before numbers that tell whose number it is."""
    rows = found.where(f"kind = '#' and term like '{LABEL}%'").groupBy("term").agg(
        *(F.sum(F.when(F.col("rec_id") == k, F.col("n")).otherwise(0)).alias(k) for k in UNSURE), F.sum("n").alias("all")
    )
    parts = [rows.where((F.col(k) > 0) & (F.col(k) >= LABEL_SHARE * F.col("all"))).select("term", F.lit(k).alias("kind")) for k in UNSURE]
    return parts[0].unionByName(parts[1])


def disclosures(found: DataFrame) -> DataFrame:
    """(term, named, share, behind, capital, bits): of terms beside given names or initials, how often they are beside the
    former, in what share of all places beside either, and what it tells."""
    counts = found.where(f"kind = '#' and term not like '{LABEL}%'").groupBy("term", F.col("rec_id").alias("partner")).agg(F.sum("n").alias("n"))
    behind = counts.where(F.col("partner") == BEHIND).select("term", F.col("n").alias("behind"))
    capital = counts.where(F.col("partner") == CAPITAL).select("term", F.col("n").alias("capital"))
    beside = counts.where(~F.col("partner").isin(BEHIND, CAPITAL))
    totals = counts.where("partner is null").select("term", F.col("n").alias("total"))
    prior = beside.groupBy(F.upper("partner").alias("_p")).agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy(F.lit(1))  # a row per given name or letter
    prior = prior.select("_p", "_n", F.sum("_n").over(whole).alias("_all"), F.count("*").over(whole).alias("_kinds"))
    own = beside.groupBy("term").agg(F.sum("n").alias("beside"))
    share = beside.join(own, "term").join(prior, F.upper("partner") == F.col("_p")).withColumn("_q", F.col("n") / F.col("beside"))
    # a term is held against what stands beside all others, so that one that fills a third of the corpus tells as much
    share = share.withColumn("_prior", (F.col("_n") - F.col("n") + 0.5) / (F.col("_all") - F.col("beside") + 0.5 * F.col("_kinds")))
    bits = share.groupBy("term").agg(F.max("beside").alias("beside"), F.sum(F.when(F.length("partner") > 1, F.col("n")).otherwise(0)).alias("named"), F.sum(F.col("_q") * F.log2(F.col("_q") / F.col("_prior"))).alias("bits"))
    rows = bits.join(totals, "term").join(behind, "term", "left").join(capital, "term", "left")
    part = lambda c: (F.coalesce(c, F.lit(0)) / F.col("total")).alias(c)
    return rows.select("term", "named", (F.col("beside") / F.col("total")).alias("share"), part("behind"), part("capital"), "bits")


def places(texts: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(tbl, rec_id, kind, start_pos, end_pos): every place of personal information in (tbl, rec_id, text).

    Positions count code points from 0, the end is not included. Places do not overlap; of overlapping names the one
    with the more telling term counts, then the earlier. Repeated rows of a record count once. Null and empty texts
    have no places. Without people (display, aliases) given names are those of the table.
    """
    given = learned_given(people, texts) if people is not None else frozenset()
    found = checkpoint(scan(texts, given))
    called = (F.col("named") >= MANY_PLACES) & (F.col("capital") >= CAPITAL_SHARE)
    rare = ((F.col("share") >= LEAST_SHARE) | called) & (F.col("bits") >= LEAST_BITS)
    common = (F.col("share") >= COMMON_SHARE) & (F.col("behind") >= COMMON_BEHIND)
    telling = disclosures(found).where(rare | common).select("term", "bits")
    names = found.where("kind = 'name?'").select("tbl", "rec_id", "start_pos", "end_pos", "term").distinct().join(telling, "term")
    record = names.groupBy("tbl", "rec_id").agg(F.collect_list(F.struct((-F.col("bits")).alias("b"), "start_pos", "end_pos")).alias("_all"))
    chosen = F.aggregate(
        F.array_sort("_all"),
        F.array().cast("array<struct<b:double,start_pos:bigint,end_pos:bigint>>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: (k.start_pos < x.end_pos) & (x.start_pos < k.end_pos)), kept).otherwise(F.concat(kept, F.array(x))),
    )
    named = record.select("tbl", "rec_id", F.lit("name").alias("kind"), F.explode(chosen).alias("_s")).select("tbl", "rec_id", "kind", "_s.start_pos", "_s.end_pos")
    keys = ["tbl", "rec_id", "kind", "start_pos", "end_pos"]
    unsure = found.where("kind <> 'name?' and kind like '%?'").withColumn("kind", F.regexp_replace("kind", "[?]$", ""))
    unsure = unsure.join(labels(found), ["term", "kind"]).select(*keys)
    formed = found.where("kind <> '#' and kind not like '%?'").select(*keys).unionByName(unsure).distinct()
    return formed.unionByName(named)


def replace(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(tbl, rec_id, text): texts with each place replaced by a placeholder of its kind, the rest unchanged."""
    spans = found.groupBy("tbl", "rec_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("__tw_spans"))
    spans = spans.withColumnsRenamed({"tbl": "__tw_t", "rec_id": "__tw_r"})
    joined = texts.join(spans, (F.col("tbl") == F.col("__tw_t")) & (F.col("rec_id") == F.col("__tw_r")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    kept = lambda acc, x: F.substring(F.col("text"), (acc.at + 1).cast("int"), (x.start_pos - acc.at).cast("int"))
    step = lambda acc, x: F.struct(F.concat(acc.out, kept(acc, x), F.lit("["), F.upper(x.kind), F.lit("]")).alias("out"), x.end_pos.alias("at"))
    rest = lambda acc: F.concat(acc.out, F.substring(F.col("text"), (acc.at + 1).cast("int"), F.lit(1 << 30)))
    clean = F.when(F.col("__tw_spans").isNull(), F.col("text")).otherwise(F.aggregate("__tw_spans", start, step, rest))
    return joined.select("tbl", "rec_id", clean.alias("text"))

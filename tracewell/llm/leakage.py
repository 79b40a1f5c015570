"""Evaluation texts leaking into training text: spaced-seed hashing.

Texts become words in a form that undoes retyping (letter case, look-alike letters of another script, digits read for
letters). Fixed masks select some of the positions of a window and ignore the others, so that a changed word does not
hide a copy. Selections of the evaluation items are hashed to a table of seeds; one scan of the corpus hashes every
document's selections, and those that a filter of fixed size lets through are joined with the seeds. A document is then
compared with each item it met, around the hits, also with single wrong letters. Only seeds with a telling word (a
figure, or a word of few items) are used, and only stretches whose telling words agree count: a passage that is built
alike but tells of other names and figures shares the frame, not these. Prompts that are the same are one, and a long
passage counts once, however many items have it; a long passage without any telling word must agree as it is.

What is telling is counted over all items, and everything else concerns one item and one document, so the result does
not depend on how items or documents are spread over tasks. Nothing is collected but the filter's bits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import bounded_broadcast, checkpoint

#: Seeds: 1 selects a word of the window, 0 ignores it.
MASKS = ("1111", "110011", "101101", "11000101", "1010011")
#: Bits of the filter that a document's seeds pass before they are joined (2 MiB, whatever the number of items).
FILTER_BITS = 24
#: Seeds, items and ids of documents up to which these are sent to every task instead of being joined by shuffle.
SEEDS_AT_ONCE, ITEMS_AT_ONCE, DOCS_AT_ONCE = 200_000, 5_000, 1_000_000
#: A word is telling if it has a digit or occurs in at most this share of the items (at least in TELLING_LEAST).
TELLING_SHARE, TELLING_LEAST = 0.04, 2
#: Least share of an item's words that must be found, and least words.
LEAST_SHARE, LEAST_WORDS = 0.25, 8
#: Words from which on a run that items share is one passage: its words count once, and it needs no telling word.
PASSAGE = 16
#: A stretch ends where the next word that agrees is further away.
STRETCH_GAP = 4
#: Texts that are searched together.
TEXTS_AT_ONCE = 256
#: Distinct words remembered per process.
MEMORY = 400_000

#: Letters that look alike in Cyrillic and Latin (first and second line), digits read for letters.
LOOK_ALIKE = str.maketrans("авекмнорстухіїјѕԁӏ", "abekmhopctyxiijsdl")
READ_AS = str.maketrans("01589", "olsbg")
#: Soft hyphen, zero-width characters, word joiner, byte order mark and combining acute, which are dropped.
DROPPED = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x301))
ALIKE = LOOK_ALIKE | DROPPED
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text in comparable form."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower().translate(ALIKE)
    else:
        text = text.lower()
    found = WORD.findall(text.replace("rn", "m"))
    return [w if w.isalpha() or w.isdigit() else w.translate(READ_AS).replace("rn", "m") for w in found]


OFFSETS = [np.array([i for i, x in enumerate(m) if x == "1"]) for m in MASKS]
WIDEST = max(map(len, MASKS))


def _deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word}


class Hashes(dict):
    """Word to 64 bits."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Item:
    """The words of an item, numbered from 1, and which of them tell; 0 is every other word."""

    def __init__(self, wanted: list[str], telling: list[bool], rare: list[bool]) -> None:
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(wanted))}
        self.near: dict[str, set[int]] = defaultdict(set)
        for w, i in self.number.items():
            if len(w) >= 5 and w.isalpha():
                for x in _deletions(w):
                    self.near[x].add(i)
        self.ids = np.array([self.number[w] for w in wanted], dtype=np.int64)
        self.telling, self.rare = (np.zeros(len(self.number) + 1, dtype=bool) for _ in range(2))
        self.telling[self.ids], self.rare[self.ids] = telling, rare

    def of(self, words_: list[str]) -> np.ndarray:
        """The numbers of a text's words; a word with one wrong letter counts if it can only be one of the item's."""
        out = np.zeros(len(words_), dtype=np.int64)
        for p, w in enumerate(words_):
            i = self.number.get(w)
            if i is None and len(w) >= 5 and w.isalpha():
                found = set().union(*(self.near.get(x, ()) for x in _deletions(w)))
                i = found.pop() if len(found) == 1 else 0
                self.number[w] = i
            out[p] = i or 0
        return out

    def told(self, places: np.ndarray, matched: np.ndarray) -> None:
        """Marks the stretches of ``places`` (words of the item that agree, ascending) whose telling words agree.

        An item with names or rare words must agree in these too: figures meet by chance. Where two thirds of a stretch
        agree, changed words inside it that are not telling belong to the passage too.
        """
        wanted = self.ids
        for stretch in np.split(places, np.flatnonzero(np.diff(places) > STRETCH_GAP) + 1):
            if len(stretch) < 3:
                continue
            whole, agree = wanted[stretch[0] : stretch[-1] + 1], wanted[stretch]
            bare = not self.telling[whole].any() and len(whole) >= min(PASSAGE, len(wanted)) and 3 * len(agree) >= 2 * len(whole)
            if bare or _mostly(self.telling, agree, whole, 3, 5) and (not self.rare.any() or _mostly(self.rare, agree, whole, 2, 3)):
                if 3 * len(agree) >= 2 * len(whole):
                    matched[stretch[0] : stretch[-1] + 1] |= ~self.telling[whole]
                matched[stretch] = True

    def covered(self, ids: np.ndarray, shifts: list[int]) -> int:
        """Words of the item that the text reproduces around hits (place in the text less place in the item).

        Each shift is followed over substituted words; where words were also left out or put in, the longest common
        blocks of the region are taken besides.
        """
        wanted = self.ids
        n = len(wanted)
        matched = np.zeros(n, dtype=bool)
        for shift in shifts:
            low, high = max(0, -shift), min(n, len(ids) - shift)
            self.told(np.flatnonzero(ids[low + shift : high + shift] == wanted[low:high]) + low, matched)
        if 2 * matched.sum() < n:
            order = np.array(sorted(shifts))
            target = wanted.tolist()
            for region in np.split(order, np.flatnonzero(np.diff(order) > n) + 1):
                text = ids[max(0, int(region[0]) - n // 2) : int(region[-1]) + n + n // 2].tolist()
                blocks = SequenceMatcher(None, target, text, autojunk=False).get_matching_blocks()
                self.told(np.array([i for a, _, size in blocks for i in range(a, a + size)], dtype=np.int64), matched)
        return int(matched.sum())

    def leaked(self, words_: list[str], shifts: list[int]) -> bool:
        """Whether a text reproduces at least ``LEAST_SHARE`` of the item, and of a short one all."""
        n = len(self.ids)
        return self.covered(self.of(words_), shifts) >= min(max(LEAST_WORDS, LEAST_SHARE * n), n)


def _mostly(kind: np.ndarray, agree: np.ndarray, whole: np.ndarray, part: int, of: int) -> bool:
    """Whether words of a kind agree, and at least ``part`` / ``of`` of the different ones in the stretch."""
    agree, whole = np.unique(agree), np.unique(whole)
    return 0 < (n := int(kind[agree].sum())) and of * n >= part * int(kind[whole].sum())


def _mix(chosen: np.ndarray, mask: int) -> np.ndarray:
    """64-bit hashes of the rows of ``chosen``."""
    h = np.full(len(chosen), 0x9E3779B97F4A7C15 + mask, dtype=np.uint64)
    for j in range(chosen.shape[1]):
        h = (h ^ chosen[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


def _bare(telling: np.ndarray) -> np.ndarray:
    """Which words of an item stand in a long run without a telling word."""
    out = np.zeros(len(telling), dtype=bool)
    ends = np.flatnonzero(np.concatenate(([True], telling, [True])))
    for low, high in zip(ends[:-1].tolist(), (ends[1:] - 1).tolist()):
        out[low:high] = high - low >= min(PASSAGE, len(telling))
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(texts: pa.Array) -> pa.Array:
    return pa.array([words(x) if x else [] for x in texts.to_pylist()], type=pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _runs(listed: pa.Array) -> pa.Array:
    """A hash for each run of ``PASSAGE`` words, by place."""
    rows = [[xxhash.xxh64_intdigest("\0".join(ws[p : p + PASSAGE])) - (1 << 63) for p in range(len(ws) - PASSAGE + 1)] for ws in listed.to_pylist()]
    return pa.array(rows, type=pa.list_(pa.int64()))


def told_words(classes: DataFrame) -> DataFrame:
    """(class, words, telling, rare) of classes (class, words, times): for each word whether it tells, and is no figure.

    A word tells if it has a digit, if few items have it, or few prompts where repeated prompts and passages count once.
    """
    runs = classes.select("class", F.posexplode(_runs(F.col("words"))).alias("p", "run"))
    first = runs.groupBy("run").agg(F.min("class").alias("_first"))
    known = runs.join(first, "run").where("_first < class").select("class", F.explode(F.sequence(F.col("p"), F.col("p") + PASSAGE - 1)).alias("p")).distinct()
    each = checkpoint(classes.select("class", "times", F.posexplode("words").alias("p", "word")))
    fresh = each.join(known.withColumn("_known", F.lit(True)), ["class", "p"], "left").groupBy("class", "word").agg(F.max("times").alias("times"), F.max(F.col("_known").isNull()).alias("fresh"))
    totals = classes.agg(F.lit(1).alias("_one"), F.coalesce(F.sum("times"), F.lit(0)).alias("_items"), F.count("*").alias("_prompts"))
    counts = fresh.groupBy("word").agg(F.sum("times").alias("n"), F.count_if("fresh").alias("once"), F.lit(1).alias("_one")).join(F.broadcast(totals), "_one")  # one row
    few = (F.col("n") <= F.greatest(F.lit(float(TELLING_LEAST)), TELLING_SHARE * F.col("_items"))) | (F.col("once") <= F.greatest(F.lit(1.0), TELLING_SHARE * F.col("_prompts")))
    figure = F.regexp_like("word", F.lit(r"\p{Nd}"))
    judged = counts.select("word", (few | figure).alias("telling"), (few & ~figure).alias("rare"))
    listed = F.array_sort(F.collect_list(F.struct("p", "word", "telling", "rare"))).alias("_w")
    rows = each.join(judged, "word").groupBy("class").agg(listed)
    return rows.select("class", F.col("_w.word").alias("words"), F.col("_w.telling").alias("telling"), F.col("_w.rare").alias("rare"))


def seeds(items: DataFrame) -> DataFrame:
    """(hash, class, place) of items (class, words, telling): selections with a telling word, or inside a bare run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, dtype=t)] for t in (np.uint64, np.int64, np.int64)]
            for k, ws, told in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, telling = np.array([hashes[w] for w in ws], dtype=np.uint64), np.array(told, dtype=bool)
                bare = _bare(telling)
                for m, offsets in enumerate(OFFSETS):
                    at = np.arange(max(0, len(ids) - int(offsets[-1])))
                    window = at[:, None] + np.arange(int(offsets[-1]) + 1)[None, :]
                    at = at[telling[at[:, None] + offsets[None, :]].any(axis=1) | bare[window].all(axis=1)]
                    for column, values in zip(out, (_mix(ids[at[:, None] + offsets[None, :]], m), np.full(len(at), k), at)):
                        column.append(values)
            whole = [np.concatenate(c) for c in out]
            yield pa.record_batch([pa.array(whole[0].view(np.int64)), pa.array(whole[1], pa.int64()), pa.array(whole[2], pa.int64())], names=["hash", "class", "place"])

    return items.select("class", "words", "telling").mapInArrow(run, "hash bigint, class bigint, place bigint").distinct()


def seed_filter(table: DataFrame) -> np.ndarray:
    """The bits of the high parts of all hashes; each task sends as many bits, whatever it read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in table.select("hash").mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, dtype=np.uint8)
    return out


def likely(documents: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, hash, at): selections of documents (doc_id, text) that the filter lets through."""
    held = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, let = Hashes(), np.unpackbits(held.value).astype(bool)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                docs = batch.column(0)[low : low + TEXTS_AT_ONCE].to_numpy(zero_copy_only=False)
                parts = [list(map(hashes.__getitem__, words(t))) if t else [] for t in batch.column(1)[low : low + TEXTS_AT_ONCE].to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                ids = np.array([x for p in parts for x in p], dtype=np.uint64)
                own = np.repeat(np.arange(len(parts)), np.diff(starts))
                found_h, found_p = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
                for m, offsets in enumerate(OFFSETS):
                    n = len(ids) - int(offsets[-1])
                    if n <= 0:
                        continue
                    h = _mix(np.stack([ids[o : o + n] for o in offsets], axis=1), m)
                    at = np.flatnonzero(let[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    at = at[own[at] == own[at + int(offsets[-1])]]
                    found_h.append(h[at])
                    found_p.append(at)
                h, at = np.concatenate(found_h), np.concatenate(found_p)
                if len(at):
                    yield pa.record_batch([pa.array(docs[own[at]], pa.int64()), pa.array(h.view(np.int64)), pa.array(at - starts[own[at]], pa.int64())], names=["doc_id", "hash", "at"])

    return documents.select("doc_id", "text").where("doc_id is not null and text <> ''").mapInArrow(run, "doc_id bigint, hash bigint, at bigint")


def verified(met: DataFrame) -> DataFrame:
    """(doc_id, class) of rows (doc_id, text, class, words, telling, rare, shifts) whose text reproduces the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Item] = {}
        text, listed = None, []
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                doc, t, k = (columns[c][i].as_py() for c in range(3))
                if k not in known:
                    if len(known) >= ITEMS_AT_ONCE:
                        known.clear()
                    known[k] = Item(*(columns[c][i].as_py() for c in (3, 4, 5)))
                if t != text:
                    text, listed = t, words(t)
                if known[k].leaked(listed, columns[6][i].as_py()):
                    out[0].append(doc)
                    out[1].append(k)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["doc_id", "class"])

    rows = met.select("doc_id", "text", "class", "words", "telling", "rare", "shifts")
    return rows.mapInArrow(run, "doc_id bigint, class bigint")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document of (doc_id, text) with each item of (item_id, prompt) that leaked into it, once.

    Null and empty texts and prompts leak nothing. An item of fewer than ``LEAST_WORDS`` words must be there whole.
    Items that share a passage all count; of repeated rows of a document, or an item, each different text counts.
    """
    listed = items.where("item_id is not null and prompt is not null").select("item_id", "prompt").distinct().select("item_id", _words(F.col("prompt")).alias("words"))
    listed = checkpoint(listed.where(F.size("words") > 0))
    classes = checkpoint(listed.groupBy("words").agg(F.min("item_id").alias("low"), F.count_distinct("item_id").alias("times")))
    # repeated ids with different prompts may share the smallest id
    order = Window.partitionBy("low").orderBy("words")
    classes = classes.select("words", "times", F.xxhash64("low", F.row_number().over(order)).alias("class"))
    classes = checkpoint(classes)
    told = checkpoint(told_words(classes))
    table = checkpoint(seeds(told))
    texts = documents.select("doc_id", "text").where("doc_id is not null and text <> ''")
    hits = likely(texts, seed_filter(table)).join(bounded_broadcast(table, SEEDS_AT_ONCE), "hash")
    hits = hits.groupBy("doc_id", "class").agg(F.array_sort(F.collect_set(F.col("at") - F.col("place"))).alias("shifts"))
    hits = checkpoint(hits)
    # texts that met nothing are left out before any text is moved
    texts = texts.join(bounded_broadcast(hits.select("doc_id").distinct(), DOCS_AT_ONCE), "doc_id", "left_semi").distinct()
    met = hits.join(bounded_broadcast(told, ITEMS_AT_ONCE), "class").join(texts, "doc_id")
    members = listed.join(classes, "words").select("class", "item_id")
    found = verified(met).distinct().join(bounded_broadcast(members.distinct()), "class")
    return found.select("doc_id", "item_id").distinct()

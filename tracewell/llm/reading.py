"""Reading level of each document.

Every sentence is classified by a regularised softmax model over words and over the characters of words (n-grams within
a word), so unseen words still count by their letters. A document's level comes from the mean of its sentences'
distributions, once per sentence and once per word, through a calibration that is fitted on sentences the model had not
seen. The model is fitted on a bounded sample of graded documents and is of fixed size; every document is then graded
in one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import bounded_broadcast

LEVELS = 5
#: Grades that the model is fitted on at most, chosen by a hash of the document.
MOST_GRADES = 3_000
#: Documents below so many words are not graded.
LEAST_WORDS = 40
#: Hashed character n-grams and their lengths.
GRAMS, GRAM_LENGTHS = 1 << 15, (2, 3, 4)
#: Penalties of word and character weights, steps and their size.
WORD_PENALTY, GRAM_PENALTY, STEPS, RATE = 2e-4, 2e-4, 60, 0.15
TEXTS_AT_ONCE = 256
MEMORY = 300_000

#: A word, a number, or the end of a sentence.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[.!?…]+(?=\s|$)|\n+")
END = 0


def grams(word: str) -> np.ndarray:
    """Hashed n-grams of a word with its ends marked."""
    w = f"^{word}$"
    codes = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    out = []
    for n in GRAM_LENGTHS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, 1469598103934665603 + n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(1099511628211)
            out.append((h >> np.uint64(20)) % np.uint64(GRAMS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


class Words(dict):
    """Token to number: 0 ends a sentence, all figures are one word."""

    def __init__(self) -> None:
        super().__init__()
        self.listed: list[str] = ["."]

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c in ".!?…\n":
            number = END
        elif c.isdigit() and token != "0":
            number = self["0"]
        else:
            number = len(self.listed)
            self.listed.append(token)
        self[token] = number
        return number


class Sentences:
    """Texts as flat word numbers with sentence and text boundaries."""

    def __init__(self, texts: list[str], words: Words) -> None:
        flat: list[int] = []
        lengths = []
        for text in texts:
            own = list(map(words.__getitem__, TOKEN.findall(text.lower())))
            own.append(END)
            flat.extend(own)
            lengths.append(len(own))
        tokens = np.array(flat, dtype=np.int64)
        text_of = np.repeat(np.arange(len(texts)), lengths)
        ended = np.cumsum(tokens == END)
        real = tokens != END
        self.words = tokens[real]
        sentence = ended[real]
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        self.starts = first
        self.sizes = np.diff(np.append(first, len(sentence)))
        self.text_of = text_of[real][first]
        self.n = len(first)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Means over each sentence of a row per word."""
        return np.add.reduceat(values, self.starts, axis=0) / self.sizes[:, None] if self.n else np.zeros((0, values.shape[1]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _ascend(parameters: list[np.ndarray], gradient, steps: int, rate: float) -> None:
    """Adam on full batches; changes ``parameters``."""
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(parameters, gradient(), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def fit_sentences(s: Sentences, targets: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word weights, n-gram weights, bias) for sentences with target distributions."""
    own = [grams(w) if i else np.zeros(0, dtype=np.int64) for i, w in enumerate(words)]
    sizes = np.array([max(1, len(g)) for g in own])
    gram, of_word = np.concatenate(own), np.repeat(np.arange(len(words)), [len(g) for g in own])
    share = 1.0 / sizes[of_word]
    u, g, b = np.zeros((len(words), LEVELS)), np.zeros((GRAMS, LEVELS)), np.zeros(LEVELS)
    weight = 1.0 / s.sizes
    per_word = np.repeat(np.arange(s.n), s.sizes)

    def gradient() -> list[np.ndarray]:
        v = u.copy()
        for c in range(LEVELS):
            v[:, c] += np.bincount(of_word, weights=g[gram, c] * share, minlength=len(words))
        p = softmax(SCALE * s.sums(v[s.words]) + b)
        r = (p - targets) / s.n
        rows = SCALE * (r * weight[:, None])[per_word]
        dv = np.stack([np.bincount(s.words, weights=rows[:, c], minlength=len(words)) for c in range(LEVELS)], axis=1)
        dg = np.stack([np.bincount(gram, weights=dv[of_word, c] * share, minlength=GRAMS) for c in range(LEVELS)], axis=1)
        return [dv + WORD_PENALTY * u / LEVELS, dg + GRAM_PENALTY * g / LEVELS, r.sum(axis=0)]

    _ascend([u, g, b], gradient, STEPS, RATE)
    return u, g, b


#: Sharpness of a sentence's mean weight.
SCALE = 4.0


class Model:
    """Word and character weights, and the calibration of documents."""

    def __init__(self, texts: list[str], targets: np.ndarray, folds: np.ndarray) -> None:
        words = Words()
        whole = Sentences(texts, words)
        listed = list(words.listed)
        held = np.zeros((len(texts), 2 * LEVELS))
        for fold in (0, 1):
            train, test = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            if not len(train) or not len(test):
                continue
            part = Sentences([texts[i] for i in train], words)
            self._set(listed, *fit_sentences(part, targets[train][part.text_of], listed))
            held[test] = self.features([texts[i] for i in test])
        self._set(listed, *fit_sentences(whole, targets[whole.text_of], listed))
        seen = held.any(axis=1)
        if not seen.any():
            held, seen = self.features(texts), np.ones(len(texts), dtype=bool)
        x, y = held[seen], targets[seen]
        self.a, self.c = np.vstack([np.eye(LEVELS), np.eye(LEVELS)]) * 2.0, np.zeros(LEVELS)
        near = self.a.copy()

        def gradient() -> list[np.ndarray]:
            r = (softmax(x @ self.a + self.c) - y) / len(x)
            return [x.T @ r + 1e-3 * (self.a - near), r.sum(axis=0)]

        _ascend([self.a, self.c], gradient, 300, 0.05)

    def _set(self, listed: list[str], u: np.ndarray, g: np.ndarray, b: np.ndarray) -> None:
        self.known = {w: u[i].astype(np.float32) for i, w in enumerate(listed) if i}
        self.g, self.b = g.astype(np.float32), b
        self._reset()

    def _reset(self) -> None:
        self.words, self.table, self.filled = Words(), np.zeros((1024, LEVELS), dtype=np.float32), 1

    def _weights(self) -> np.ndarray:
        """A row per word number met so far."""
        if len(self.words.listed) > len(self.table):
            self.table = np.vstack([self.table, np.zeros((2 * len(self.words.listed), LEVELS), dtype=np.float32)])
        for i in range(self.filled, len(self.words.listed)):
            w = self.words.listed[i]
            at = grams(w)
            self.table[i] = self.known.get(w, 0.0) + (self.g[at].mean(axis=0) if len(at) else 0.0)
        self.filled = len(self.words.listed)
        return self.table

    def features(self, texts: list[str]) -> np.ndarray:
        """Mean distribution over sentences, and over words, of each text."""
        if len(self.words.listed) > MEMORY:
            self._reset()
        s = Sentences(texts, self.words)
        p = softmax(SCALE * s.sums(self._weights()[s.words]) + self.b)
        out = np.zeros((len(texts), 2 * LEVELS))
        for c in range(LEVELS):
            out[:, c] = np.bincount(s.text_of, weights=p[:, c], minlength=len(texts))
            out[:, LEVELS + c] = np.bincount(s.text_of, weights=p[:, c] * s.sizes, minlength=len(texts))
        out[:, :LEVELS] /= np.maximum(out[:, :LEVELS].sum(axis=1, keepdims=True), 1e-9)
        out[:, LEVELS:] /= np.maximum(out[:, LEVELS:].sum(axis=1, keepdims=True), 1e-9)
        return out

    def distributions(self, texts: list[str]) -> np.ndarray:
        """Calibrated probability of each level for each text."""
        return softmax(self.features(texts) @ self.a + self.c)


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """A model from (doc_id, text) and grades (doc_id, reading_level); None without a usable grade.

    At most ``MOST_GRADES`` documents are used, those with the smallest hash of their id. Grades of several raters are
    averaged; grades outside 1 to 5, and of documents that do not exist or have no text, are not used.
    """
    good = labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull())
    given = F.array(*(F.count_if(F.col("reading_level") == k + 1) for k in range(LEVELS))).alias("grades")
    sample = good.groupBy("doc_id").agg(given)
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_GRADES).withColumnRenamed("doc_id", "_doc")
    graded = documents.select("doc_id", "text").join(bounded_broadcast(sample, MOST_GRADES), F.col("doc_id") == F.col("_doc"))
    graded = graded.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grades").alias("grades"))
    rows = graded.where("text is not null").select("doc_id", "text", "grades", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold")).collect()
    rows = sorted((r for r in rows if r.text.strip()), key=lambda r: (r.doc_id, r.text))
    if not rows:
        return None
    targets = np.array([r.grades for r in rows], dtype=float)
    targets /= targets.sum(axis=1, keepdims=True)
    return Model([r.text for r in rows], targets, np.array([r.fold for r in rows]))


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level, difficulty): every running text of (doc_id, text, source) with its level from 1 to 5.

    Graded is each text of at least 40 words that is no sheet (source ``xlsx``); null texts are none, a null source
    is no sheet. difficulty is the expected level. Without any usable grade the result is empty.
    """
    spark = documents.sparkSession
    model = fit(documents, labels)
    if model is None:
        return spark.createDataFrame([], "doc_id bigint, reading_level bigint, difficulty double")
    model._reset()
    held = spark.sparkContext.broadcast(model)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            keys, level, expected = [], [], []
            for low in range(0, len(ids), TEXTS_AT_ONCE):
                part = [(i, t) for i, t in zip(ids[low : low + TEXTS_AT_ONCE], texts[low : low + TEXTS_AT_ONCE].to_pylist()) if len(t.split()) >= LEAST_WORDS]
                if part:
                    p = model.distributions([t for _, t in part])
                    keys += [i for i, _ in part]
                    level += (p.argmax(axis=1) + 1).tolist()
                    expected += (p @ np.arange(1, LEVELS + 1)).tolist()
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(level, pa.int64()), pa.array(expected, pa.float64())], names=["doc_id", "reading_level", "difficulty"])

    running = documents.where(F.col("text").isNotNull() & ~F.col("source").eqNullSafe("xlsx")).select("doc_id", "text")
    return running.mapInArrow(grade, "doc_id bigint, reading_level bigint, difficulty double")

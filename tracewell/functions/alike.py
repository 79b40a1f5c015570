"""Likeness of two blocks of texts by stems and by characters, computed for many pairs at once; runs in the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Bits of a text in one number: the last is left for what is carried to the next.
LIMB = 63
BITS, FULL = np.uint64(LIMB), np.uint64((1 << LIMB) - 1)
#: Numbers in the masks of one group of texts, and cells of one group of tables: as many as stay in a processor's cache,
#: or nearly.
MASK_CELLS, TABLE_CELLS = 1 << 21, 1 << 20
#: Pairs that may be alike and are settled together.
PAIRS_AT_ONCE = 50_000
#: From this length on of the second text ``SequenceMatcher`` passes over frequent characters; it is asked itself then.
FREQUENT_FROM = 200


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters one after another, where each text begins, lengths)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.cumsum(lengths) - lengths, lengths


class _Group:
    """Texts of about one length, with the places of each of their characters as bits."""

    def __init__(self, where: np.ndarray, limbs: int, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        self.where, self.limbs, self.lengths = where, limbs, lengths[where]
        n = self.lengths
        text = np.repeat(np.arange(len(where)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        self.letters, code = np.unique(flat[np.repeat(begins[where], n) + place], return_inverse=True)
        masks = np.zeros(len(self.letters) * limbs * len(where), dtype=np.uint64)
        np.add.at(masks, (code * limbs + place // LIMB) * len(where) + text, np.uint64(1) << (place % LIMB).astype(np.uint64))
        self.masks = masks.reshape(len(self.letters), limbs, len(where))
        counts = np.bincount(code * len(where) + text, minlength=len(self.letters) * len(where))
        self.counts = counts.astype(np.uint8 if n.max() < 256 else np.int32).reshape(len(self.letters), len(where))

    def common(self, letters: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(places in the group, length of the longest common subsequence) of the texts that may be like a text of these
        characters; those are passed over that do not share enough of each character."""
        own, at, n = np.unique(letters, return_inverse=True, return_counts=True)
        spot = np.minimum(np.searchsorted(self.letters, own), len(self.letters) - 1)
        known = self.letters[spot] == own
        spot, n = spot[known], n[known]
        limit = np.iinfo(self.counts.dtype).max
        shared = np.minimum(self.counts[spot], np.minimum(n, limit).astype(self.counts.dtype)[:, None]).sum(axis=0, dtype=self.counts.dtype)
        likely = np.flatnonzero(2.0 * shared / (self.lengths + len(letters)) >= threshold)
        if not len(likely):
            return likely, likely
        masks = self.masks[spot][:, :, likely]
        row = np.cumsum(known) - 1
        rest = np.full((self.limbs, len(likely)), FULL)
        hit, total, carried = np.empty_like(rest), np.empty_like(rest), np.empty(len(likely), dtype=np.uint64)
        for i in row[at[known[at]]].tolist():
            np.bitwise_and(rest, masks[i], out=hit)
            np.add(rest, hit, out=total)
            for w in range(1, self.limbs):
                np.right_shift(total[w - 1], BITS, out=carried)
                np.add(total[w], carried, out=total[w])
            np.subtract(rest, hit, out=rest)
            np.bitwise_or(rest, total, out=rest)
            np.bitwise_and(rest, FULL, out=rest)
        return likely, LIMB * self.limbs - np.bitwise_count(rest).sum(axis=0, dtype=np.int64)


def _groups(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> list[_Group]:
    limbs = np.maximum(-(-lengths // LIMB), 1)
    limbs = np.where(limbs <= 4, limbs, 1 << np.ceil(np.log2(limbs)).astype(np.int64))
    letters, out = len(np.unique(flat)), []
    for w in np.unique(limbs).tolist():
        where, most = np.flatnonzero(limbs == w), max(1, MASK_CELLS // (letters * w))
        out += [_Group(where[i : i + most], w, flat, begins, lengths) for i in range(0, len(where), most)]
    return out


def _longest(flat: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, place in a, place in b) of the longest common stretch of each pair of texts, the first of equals in a, then in b."""
    rows, columns, many = int(n.max()), int(m.max()), np.arange(len(a))
    i, j = np.arange(rows)[:, None], np.arange(columns)[:, None]
    left = np.where(i < n, flat[np.minimum(a + i, len(flat) - 1)], flat.dtype.type(0))
    right = np.where(j < m, flat[np.minimum(b + j, len(flat) - 1)], flat.dtype.type(1))
    table = np.zeros((rows + 1, columns + 1, len(a)), dtype=np.uint8)
    same, longer = np.empty((columns, len(a)), dtype=bool), np.empty((columns, len(a)), dtype=np.uint8)
    top = np.empty((rows, len(a)), dtype=np.uint8)
    for r in range(rows):
        np.equal(right, left[r], out=same)
        np.add(table[r, :-1], np.uint8(1), out=longer)
        np.multiply(longer, same.view(np.uint8), out=table[r + 1, 1:])
        table[r + 1].max(axis=0, out=top[r])
    end = top.argmax(axis=0)
    length = top[end, many].astype(np.int64)
    return length, end + 1 - length, table[end + 1, :, many].argmax(axis=1) - length


def matched(flat: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Characters in the matching blocks of ``SequenceMatcher``, for each pair of a text of n characters from a on and one of
    m, less than FREQUENT_FROM, from b on; flat has no 0 and no 1."""
    out, pair = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    while len(pair):
        size = np.ceil(np.log(n) / np.log(1.4)).astype(np.int64) * 64 + np.ceil(np.log(m) / np.log(1.4)).astype(np.int64)
        order = np.argsort(size, kind="stable")
        pair, a, n, b, m, size = (x[order] for x in (pair, a, n, b, m, size))
        found = []
        for low, high in zip(starts := np.flatnonzero(np.diff(size, prepend=-1)), [*starts[1:], len(size)]):
            step = max(1, TABLE_CELLS // int(n[low:high].max() * m[low:high].max()))
            found += [_longest(flat, *(x[i : min(i + step, high)] for x in (a, n, b, m))) for i in range(low, high, step)]
        k, i, j = (np.concatenate(x) for x in zip(*found))
        out += np.bincount(pair, weights=k, minlength=len(out)).astype(np.int64)
        pair, a, n, b, m = (
            np.concatenate(x) for x in ((pair, pair), (a, a + i + k), (np.where(k > 0, i, 0), np.where(k > 0, n - i - k, 0)), (b, b + j + k), (j, m - j - k))
        )
        left = (n > 0) & (m > 0)
        pair, a, n, b, m = (x[left] for x in (pair, a, n, b, m))
    return out


def alike(asked: list[tuple[str, list[str]]], texts: list[tuple[str, list[str]]], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in asked, place in texts, similarity) of texts with their stems, in parts: the larger of the share of the
    smaller set of stems and the ratio of ``SequenceMatcher``, where it reaches the threshold.

    The ratio is not computed where it can neither reach the threshold nor exceed the share of stems: it is at most what two
    texts have of each character in common, and at most their longest common subsequence.
    """
    letters, begins, lengths = _flat([t for t, _ in texts])
    own, own_begins, own_lengths = _flat([t for t, _ in asked])
    codes = np.unique(np.concatenate([own, letters]), return_inverse=True)[1] + 2
    codes = codes.astype(np.uint8 if codes.max(initial=0) < 256 else np.uint32)
    groups, sizes, with_stem = _groups(letters, begins, lengths), np.array([len(s) for _, s in texts]), {}
    for i, (_, s) in enumerate(texts):
        for x in s:
            with_stem.setdefault(x, []).append(i)
    with_stem = {x: np.array(i) for x, i in with_stem.items()}

    def settle(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, best, ask = (np.concatenate(x) for x in zip(*parts))
        short = np.flatnonzero(ask & (lengths[b] < FREQUENT_FROM))
        p, q = a[short], b[short]
        same = matched(codes, own_begins[p], own_lengths[p], len(own) + begins[q], lengths[q])
        best[short] = np.maximum(best[short], 2.0 * same / (own_lengths[p] + lengths[q]))
        for i in np.flatnonzero(ask & (lengths[b] >= FREQUENT_FROM)).tolist():
            best[i] = max(best[i], SequenceMatcher(None, asked[a[i]][0], texts[b[i]][0]).ratio())
        kept = best >= threshold
        return a[kept], b[kept], best[kept]

    parts, n = [], 0
    for q, (_, s) in enumerate(asked):
        shared = np.zeros(len(texts))
        for x in s:
            if x in with_stem:
                shared[with_stem[x]] += 1
        share, bound = shared / np.minimum(sizes, len(s)), np.zeros(len(texts))
        chars = own[own_begins[q] : own_begins[q] + own_lengths[q]]
        for g in groups:
            likely, common = g.common(chars, threshold)
            bound[g.where[likely]] = 2.0 * common / (g.lengths[likely] + len(chars))
        ask = (bound >= threshold) & (bound > share)
        hits = np.flatnonzero(ask | (share >= threshold))
        parts.append((np.full(len(hits), q), hits, share[hits], ask[hits]))
        n += len(hits)
        if n >= PAIRS_AT_ONCE:
            yield settle(parts)
            parts, n = [], 0
    if parts:
        yield settle(parts)

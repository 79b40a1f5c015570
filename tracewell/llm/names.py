"""Names and accounts as people type them, in comparable form."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

import numpy as np

#: Given names with their usual nicknames and Russian spellings. A bonus: names that are not here are
#: compared as words.
GIVEN = {
    "aleksandr": "alex alexander alexandr sasha sanya александр саша",
    "anastasia": "nastya anastasiya анастасия настя",
    "barbara": "babs varya varvara барбара варя варвара",
    "christopher": "chris kit кристофер крис",
    "dmitri": "dima mitya dmitry dmitriy дмитрий дима митя",
    "ekaterina": "katya kate katerina catherine екатерина катя",
    "elizaveta": "liza liz elisabeth elizabeth елизавета лиза",
    "evgeni": "zhenya gene evgeny evgeniy eugene евгений женя",
    "friedrich": "fritz фридрих фриц",
    "grigori": "grisha greg grigory grigoriy григорий гриша",
    "hendrik": "henk хендрик хенк",
    "isabel": "bella izzy isabelle изабель белла",
    "johanna": "jo hanna йоханна ханна",
    "konstantin": "kostya константин костя",
    "leonid": "leo lyonya леонид лёня леня",
    "margareta": "rita greta margarita маргарита рита",
    "mikhail": "misha mike michael михаил миша",
    "nikolai": "kolya nick nikolay николай коля",
    "oksana": "ksana оксана ксана",
    "patricia": "pat trish патриция пат",
    "pavel": "pasha paul павел паша",
    "robert": "rob bob роберт роб",
    "sofia": "sonya sofiya sophia софия соня",
    "tatiana": "tanya tatyana татьяна таня",
    "theodor": "ted theo теодор тео",
    "ulyana": "ulya ульяна уля",
    "vladimir": "vova volodya владимир вова володя",
    "william": "will bill уильям билл",
    "yulia": "yulya jules julia юлия юля",
    "zinaida": "zina зинаида зина",
}
#: Lines of business with short forms and Russian spellings; legal forms, which tell nothing.
BUSINESS = {
    "consulting": "cons konsalting консалтинг",
    "engineering": "eng инжиниринг",
    "logistics": "log logistik логистик логистикс",
    "systems": "sys системс системы",
    "trading": "trd трейдинг",
}
LEGAL = frozenset("ltd llc inc gmbh ag co corp ooo ооо зао оао".split())
#: Transliteration of Russian letters, and letters that look alike in both scripts.
LATIN = str.maketrans(
    {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k",
        "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
        "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    }
)
TO_LATIN = str.maketrans("аеорсхукмтвнієьь", "aeopcxykmtbhiebb")
TO_CYRILLIC = str.maketrans("aeopcxykmtbh", "аеорсхукмтвн")
CYRILLIC = re.compile("[а-яё]")
LETTER = re.compile(r"[a-z]")
DECORATION = re.compile(r"[\[(][^\])]*[\])]|\s[|–—-]\s.*$|\s\|.*$|[:;]-?[D()P]+")
CAMEL = re.compile(r"(?<=[a-zа-яё])(?=[A-ZА-ЯЁ][a-zа-яё]{2})")
ACCOUNT = re.compile(r"^(?:@|tg:)|\S@\S|^[a-z0-9._+-]+$")
WORD = re.compile(r"[^\W\d_]+")
APOSTROPHE = re.compile(r"(?<=[^\W\d_])['’`](?=[^\W\d_])")
#: Letters from rare to frequent ones in Latin and transliterated names (those that are not here are the rarest), for an order
#: in which few words share the first of their pairs of letters; any order finds the same.
COMMON_LETTERS = "qxjwycfzhpgbvmdulktsnr^$oiea"
#: Up to so many edits words meet after letters are left out; above, in so many pairs of letters together, by edits.
FEW_EDITS, TOGETHER = 2, ((6, 3), (24, 2), (1 << 62, 1))
#: Odd multipliers for the places of what is hashed.
POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)
#: Marks a word that stands for a given name, or a line of business, of the tables: it is that one or none.
AS_GIVEN, AS_BUSINESS = "=", "+"


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """A word without the differences between ways to write a sound in Latin letters, and without doubled letters."""
    w = word.lower()
    if CYRILLIC.search(w):
        if LETTER.search(w):
            w = w.translate(TO_LATIN) if len(CYRILLIC.findall(w)) <= len(LETTER.findall(w)) else w.translate(TO_CYRILLIC)
        w = w.translate(LATIN)
    w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    w = w.replace("tch", "ch").replace("sch", "sh").replace("ou", "u").replace("w", "v").replace("c", "k")
    return re.sub(r"(.)\1+", r"\1", w)


def _table(names: dict[str, str]) -> dict[str, str]:
    return {skeleton(v): k for k, vs in names.items() for v in [k, *vs.split()]}


GIVEN_OF, BUSINESS_OF = _table(GIVEN), _table(BUSINESS)
#: First letters under which a given name may be shortened.
INITIALS = {k: {skeleton(v)[0] for v in [k, *vs.split()] if len(v) > 3} | {k[0], skeleton(k)[0]} for k, vs in GIVEN.items()}


def osa(a: str, b: str) -> int:
    """Edits between two words: insert, delete, replace, or swap two neighbours."""
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def likeness(a: str, b: str) -> float:
    return 1 - osa(a, b) / max(len(a), len(b), 1)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the words of each name of the best likeness in the other, the smaller of both directions.

    Words that stand for given names or lines of business of the tables are equal or have nothing in common.
    """

    def one(x: str, y: str) -> float:
        return float(x == y) if x[0] in "=+" or y[0] in "=+" else likeness(x, y)

    def way(p: list[str], q: list[str]) -> float:
        return sum(max((one(x, y) for y in q), default=0.0) for x in p) / max(1, len(p))

    return min(way(a, b), way(b, a))


@lru_cache(maxsize=100_000)
def given_name(word: str) -> str | None:
    """The given name a skeleton stands for, also with one wrong letter, or two in a long one."""
    if word in GIVEN_OF:
        return GIVEN_OF[word]
    for edits, shortest in ((1, 5), (2, 7)):
        near = {k for v, k in GIVEN_OF.items() if len(v) >= shortest and abs(len(v) - len(word)) <= edits and osa(v, word) <= edits}
        if near and len(word) >= 4:
            return near.pop() if len(near) == 1 else None
    return None


def account(text: str) -> str:
    """An account or address without the ways to write it: case, ``@`` and ``tg:`` before it, white space around."""
    t = unicodedata.normalize("NFKC", text).strip().lower()
    return re.sub(r"^(?:mailto:|tg:|@|https?://(?:www\.)?|t\.me/)+", "", t).rstrip("/")


def parse(text: str | None) -> tuple[str, str, list[str]]:
    """(kind, first, words) of a name.

    kind is ``full`` (words of a person or an organisation, sorted, whatever their order in the text), ``initial`` (first
    is a letter, words the rest), or ``none`` for blanks, bare first names and single words. Given names and lines of
    business of the tables stand for all their spellings; beside one, what is left is one word. Legal forms tell
    nothing, but with one a single word is a full name. Letters between longer words are left out.
    """
    none = ("none", "", [])
    if not text:
        return none
    t = unicodedata.normalize("NFKC", text)
    if ACCOUNT.search(t.strip()):
        return none
    t = APOSTROPHE.sub("", CAMEL.sub(" ", DECORATION.sub(" ", t + " ").replace("_", " ")))
    raw = WORD.findall(t)
    legal = any(w.lower() in LEGAL for w in raw)
    words = [w for w in (skeleton(w) for w in raw if w.lower() not in LEGAL) if w]
    if sum(len(w) > 1 for w in words) > 1:
        words = [w for w in words if len(w) > 1]
    for i, w in enumerate(words):
        if w in BUSINESS_OF and len(words) > 1 and (len(w) > 3 or len(words) == 2):
            return "full", "", sorted([AS_BUSINESS + BUSINESS_OF[w], "".join(words[:i] + words[i + 1 :])])
    if legal:
        return ("full", "", sorted(words)) if words else none
    if len(words) == 1:
        w = words[0]
        for v, k in GIVEN_OF.items():
            if len(v) >= 6 and w.startswith(v) and len(w) - len(v) >= 4:
                return "full", "", sorted([AS_GIVEN + k, w[len(v) :]])
    if len(words) < 2:
        return none
    exact = [i for i, w in enumerate(words) if w in GIVEN_OF and len(w) > 1]
    near = exact or [i for i, w in enumerate(words) if given_name(w)]
    if near:
        i = near[0]
        return "full", "", sorted([AS_GIVEN + given_name(words[i]), "".join(words[:i] + words[i + 1 :])])
    for i, w in enumerate(words):
        if len(w) == 1 or (len(w) == 2 and i == 0 and w in ("kh", "yu", "ya", "ch", "sh", "zh", "ts")):
            last = "".join(words[:i] + words[i + 1 :])
            return ("initial", w[0], [last]) if len(last) > 1 else none
    return "full", "", sorted(words)


def letters(words: list[str]) -> list[tuple[str, str]]:
    """(letter, rest) under which a full name may be shortened to an initial with the rest of it."""
    given = [w for w in words if w[0] == AS_GIVEN]
    if any(w[0] == AS_BUSINESS for w in words):
        return []
    first = given or words
    return [(x, "".join(words[:i] + words[i + 1 :])) for i, w in enumerate(words) if w in first and len(words) > 1 for x in sorted(INITIALS[w[1:]] if given else {w[0]})]


def digits(acct: str) -> str:
    """The numbers in an account before its domain."""
    return " ".join(re.findall(r"\d+", acct.split("@")[0]))


def account_names(acct: str) -> tuple[list[str], list[tuple[str, str]]]:
    """([full name key], [(letter, rest)]) that an account may be made of."""
    local = re.sub(r"\d+[a-z]?$|-[a-z]$", "", acct.split("@")[0])
    parts = [skeleton(p) for p in re.split(r"[._\-+]+", local) if WORD.fullmatch(p)]
    if len(parts) == 2:
        keys = ["|".join(sorted([AS_GIVEN + GIVEN_OF[a], b])) if a in GIVEN_OF else "|".join(sorted([a, b])) for a, b in (parts, parts[::-1])]
        return keys, [(a[0], b) for a, b in (parts, parts[::-1]) if a not in GIVEN_OF]
    if len(parts) == 1 and len(parts[0]) > 4:
        p = parts[0]
        return [], [(p[0], p[1:]), (p[-1], p[:-1])]
    return [], []


def most_edits(n: int, share: float) -> int:
    """Edits that words may have between them which are alike, the longer of n letters."""
    return int(share * n + 1e-9)


def grams(word: str) -> list[tuple[str, int]]:
    """Padded pairs of neighbouring letters, in either order, each with how often it came before; the rarest first.

    An edit, also a swap, takes away two of them at most.
    """
    padded, seen, out = f"^{word}$", {}, []
    for x, y in zip(padded, padded[1:]):
        g = min(x, y) + max(x, y)
        out.append((g, seen.setdefault(g, 0)))
        seen[g] += 1
    return sorted(out, key=lambda e: (sum(COMMON_LETTERS.find(c) for c in e[0]), *e))


def letter_set(word: str) -> int:
    """A bit for each letter of a word; letters may share one."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 63
    return bits


@lru_cache(maxsize=10_000)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k)


def _hashes(codes: np.ndarray, k: int, kind: int) -> np.ndarray:
    """A hash of each choice of k of the codes, in their order."""
    return (codes[_choices(len(codes), k)] * POWERS[:k]).sum(axis=1, dtype=np.uint64) * np.uint64(64) + np.uint64(kind)


@lru_cache(maxsize=100_000)
def hash_gram(gram: str) -> int:
    h = 0xCBF29CE484222325
    for b in gram.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def meeting_places(word: str, share: float) -> list[int]:
    """Hashes of which two words have one in common if the edits between them are at most this share of the longer one.

    Nothing is left to chance. Two words with k edits between them, swaps among these, are equal after k letters at most are
    left out of the longer, and as many less of the shorter as it is shorter; so they meet where k is small. Where k is
    larger, words of n and N >= n letters have at least N + 1 - 2 k of their :func:`grams` in common, and some of these are
    among the rarest of each: at least c among the n - N + 2 k + c rarest of the n + 1. They meet in each choice of c.
    """
    n, left_out, rarest, longer = len(word), -1, {}, len(word)
    while longer - n <= (k := most_edits(longer, share)):
        if 0 < k <= FEW_EDITS:
            left_out = max(left_out, k - (longer - n))
        elif k:
            c = next(c for most, c in TOGETHER if k <= most)
            rarest[c] = max(rarest.get(c, 0), n - longer + 2 * k + c)
        longer += 1
    found = []
    if left_out >= 0:
        codes = np.array([hash_gram(x) for x in word], dtype=np.uint64)
        found += [_hashes(codes, n - d, 0) for d in range(min(left_out, n) + 1)]
    if rarest:
        codes = np.array([(hash_gram(g) + i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for g, i in grams(word)], dtype=np.uint64)
        found += [_hashes(codes[:most], c, c) for c, most in rarest.items()]
    return np.unique(np.concatenate(found)).astype(np.int64).tolist() if found else []

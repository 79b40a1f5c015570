"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.keys import SPACE, strip

SLUG_BYTES = 60
#: Latin spellings of Russian letters in slugs.
SLUG_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def nonblank(c: Column) -> Column:
    """Whether a text has more than white space; false for null."""
    return F.coalesce(strip(c) != "", F.lit(False))


def truthy(c: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def name_key(c: Column) -> Column:
    """A name in comparable form: lower case, letters, digits, blanks and ``_-@.`` only."""
    kept = F.regexp_replace(F.lower(strip(c)), rf"[^\p{{L}}\p{{N}}_@.\- \t\n\x0b\f\r]", "")
    return collapse(kept)


def cut_at_word(c: Column, limit: int) -> Column:
    """At most ``limit`` characters of the collapsed text, cut at a blank and marked by an ellipsis."""
    t = collapse(c)
    head = F.substring(t, 1, limit)
    at_word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.when(at_word != "", at_word).otherwise(head), F.lit("…")))


def words_over_two(c: Column) -> Column:
    """Lower-case words of more than two characters; everything but letters and digits separates."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: F.length(w) > 2)


def stems(c: Column) -> Column:
    """The distinct first five characters of :func:`words_over_two`."""
    return F.array_distinct(F.transform(words_over_two(c), lambda w: F.substring(w, 1, 5)))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements of two sets over the size of the smaller one; 0 if one is empty."""
    zero = F.lit(0)
    least = F.least(F.coalesce(F.size(a), zero), F.coalesce(F.size(b), zero))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def escape_markdown(c: Column) -> Column:
    """Text that markdown shows as it is: entities for ``&<>``, a backslash before what starts a block."""
    t = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(t, r"(?m)^([ \t]*)([#*+=|-]|[0-9]+[.)]|`{3,}|~{3,})", r"$1\\$2")


def escape_cell(c: Column) -> Column:
    """Text for a cell of a markdown table."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def inline_span(c: Column) -> Column:
    """Text for an inline code span: collapsed, without backticks."""
    return F.translate(collapse(c), "`", "'")


def url_path(c: Column) -> Column:
    """A path with everything encoded that URLs need, slashes kept."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_unpath(c: Column) -> Column:
    """The inverse of :func:`url_path`; a plus sign stays one."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def distinct_list(c: Column) -> Column:
    """A list without blanks and repetitions, elements stripped, in order."""
    stripped = F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(stripped), F.array().cast("array<string>"))


def context_reference(c: Column) -> Column:
    """Whether a text is a reference into another archive: ``ctx:slug#x001``."""
    return F.coalesce(F.regexp_like(c, F.lit(r"^ctx:[a-z0-9][a-z0-9-]*#[a-z][0-9]{3,}$")), F.lit(False))


def version_parts(c: Column) -> Column:
    """A dotted version as numbers, for comparison; [0] if it is none."""
    ok = F.regexp_like(c, F.lit(r"^[0-9]{1,9}(\.[0-9]{1,9})*$"))
    return F.when(ok, F.split(c, r"\.").cast("array<int>")).otherwise(F.array(F.lit(0)))


def contained_path(c: Column) -> Column:
    """The path as it lies under its root, null if it is empty, absolute or leads outside."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    up = lambda acc: F.struct(F.slice(acc.at, 1, F.greatest(F.size(acc.at) - 1, F.lit(0))).alias("at"), (acc.out | (F.size(acc.at) == 0)).alias("out"))
    down = lambda acc, p: F.struct(F.concat(acc.at, F.array(p)).alias("at"), acc.out.alias("out"))
    walked = F.aggregate(parts, start, lambda acc, p: F.when(p == "..", up(acc)).otherwise(down(acc, p)))
    bad = (c == "") | F.regexp_like(c, F.lit(r"^([/\\]|[A-Za-z]:)")) | walked.out | (F.size(walked.at) == 0)
    return F.when(~bad, F.array_join(walked.at, "/"))


def _slug(text: str) -> str:
    out = []
    for c in text.strip().lower():
        if c in SLUG_LETTERS:
            out.append(SLUG_LETTERS[c])
        elif c.isascii() and c.isalnum():
            out.append(c)
        else:
            out.append("".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii() and x.isalnum()) if c.isalpha() else "-")
    slug = re.sub("-+", "-", "".join(out)).strip("-")
    return slug[:SLUG_BYTES].strip("-") or "unnamed"


@F.arrow_udf(T.StringType())
def slugify(texts: pa.Array) -> pa.Array:
    """File-name form of a text: Latin letters, digits and hyphens, at most 60 bytes; null stays null.

    A letter without a Latin form is dropped, anything else becomes a hyphen.
    """
    return pa.array([None if x is None else _slug(x) for x in texts.to_pylist()], type=pa.string())


@F.arrow_udf(T.DoubleType())
def character_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp likeness of two texts."""
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in pairs], type=pa.float64())


def rich_text(v: Column) -> Column:
    """Plain text of a JSON value: a text, or a list of texts and objects with ``text``; null gives an empty text."""
    parts = F.from_json(v, "array<string>")
    piece = lambda p: F.when(F.substring(p, 1, 1) == "{", F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p)
    is_list = F.substring(F.trim(v), 1, 1) == "["
    listed = F.array_join(F.transform(parts, piece), "")
    plain = F.get_json_object(F.concat(F.lit('{"x":'), v, F.lit("}")), "$.x")
    return F.when(v.isNull(), F.lit("")).when(is_list, listed).otherwise(F.coalesce(plain, v))

"""Mixed timestamp formats and time zones.

A text is reduced to its shape: digits to 9, letters to a, everything else as it is. Each distinct shape is matched
once against a small grammar over shapes; the result, kept per process, is a parser that knows at which positions which
field stands. All texts of a shape are then converted together: their characters form a matrix whose columns are
combined to numbers, and local times go through zone transition tables (:mod:`tracewell.functions.zones`).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import zones
from tracewell.session import bounded_broadcast

#: Month names and their usual short forms in English, Russian and German.
MONTHS = {
    1: "january jan январь января янв januar jänner",
    2: "february feb февраль февраля фев februar",
    3: "march mar март марта мар märz",
    4: "april apr апрель апреля апр",
    5: "may май мая mai",
    6: "june jun июнь июня июн juni",
    7: "july jul июль июля июл juli",
    8: "august aug август августа авг",
    9: "september sep sept сентябрь сентября сен",
    10: "october oct октябрь октября окт oktober okt",
    11: "november nov ноябрь ноября ноя",
    12: "december dec декабрь декабря дек dezember dez",
}
MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}

ZONE = (
    r"(?: ?(?P<off>[+-]99(?::?99)?)(?:\[[a/_+-]+\])?| ?(?P<gmt>aaa)(?P<off2>[+-]99?(?::?99)?)"
    r"| ?(?P<abbr>a{1,5})| ?\[?(?P<iana>a+(?:[/_-]a+)+)\]?)?"
)
CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?(?: ?(?P<ap>a\.?a\.?)(?= |$))?" + ZONE
#: The grammar: field names at their places in a shape. The first match counts.
GRAMMAR = [
    re.compile(x)
    for x in (
        r"(?P<epoch>9{10})(?:\.(?P<f>9{1,9}))?",
        r"(?P<epoch>9{13}|9{16}|9{19})",
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<T>a| )?(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?" + ZONE + ")?",
        r"(?P<Y>9999)(?P<sep>[-/.])(?P<m>99?)(?P=sep)(?P<d>99?)(?:(?:(?P<T>a)|,? )" + CLOCK + ")?",
        r"(?P<d>99?)(?P<sep>[-/.])(?P<m>99?)(?P=sep)(?P<Y>9999|99)(?:,? " + CLOCK + ")?",
        r"(?:(?P<dow>a{2,12})\.?,? )?(?P<d>99?)\.? (?P<mon>a{3,9})\.?,? (?P<Y>9999)(?: a\.?)?(?:,? (?:aa? )?" + CLOCK + ")?",
        r"(?:(?P<dow>a{2,12})\.?,? )?(?P<mon>a{3,9})\.? (?P<d>99?),? (?P<Y>9999)(?:,? (?:aa )?" + CLOCK + ")?",
    )
]


#: Longer shapes are matched each time instead of being remembered.
SHAPE_CHARS = 256


@lru_cache(maxsize=65_536)
def _known(shape: str) -> dict[str, tuple[int, int]] | None:
    return parser(shape)


def parser(shape: str) -> dict[str, tuple[int, int]] | None:
    """Field to (start, end) for a shape; None if no instant has it."""
    for rule in GRAMMAR:
        if m := rule.fullmatch(shape):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _number(chars: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for i in range(*span) if span else ():
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _texts(chars: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct texts of a field and, for each row, which one it has."""
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    return np.unique(part.view(f"U{part.shape[1]}")[:, 0], return_inverse=True)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of the proleptic Gregorian calendar."""
    months = (y - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _convert(texts: list[str], zone_of_row: np.ndarray, fields: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds and validity of texts of one shape."""
    width = len(texts[0])
    chars = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    fraction = np.zeros(len(texts), dtype=np.int64)
    if "f" in fields:
        a, b = fields["f"]
        fraction = _number(chars, (a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))
    if "epoch" in fields:
        scale = {10: 1_000_000, 13: 1_000, 16: 1}.get(fields["epoch"][1] - fields["epoch"][0])
        value = _number(chars, fields["epoch"])
        return (value * scale + fraction if scale else value // 1_000), value >= 0  # 19 digits can overflow
    y, d = _number(chars, fields["Y"]), _number(chars, fields["d"])
    if fields["Y"][1] - fields["Y"][0] == 2:
        y += np.where(y < 69, 2000, 1900)
    if "mon" in fields:
        names, which = _texts(chars, fields["mon"])
        m = np.array([MONTH_OF.get(x.lower(), 0) for x in names], dtype=np.int64)[which]
    else:
        m = _number(chars, fields["m"])
        if "sep" in fields and fields["d"][0] < fields["Y"][0]:  # day first, but where only the month can be first
            swap = (m > 12) & (d <= 12) & (chars[:, fields["sep"][0]] == ord("/"))
            m, d = np.where(swap, d, m), np.where(swap, m, d)
    h, mi, s = (_number(chars, fields.get(k)) for k in "HMS")
    good = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (mi < 60) & (s < 60)
    if "T" in fields:
        good &= np.isin(chars[:, fields["T"][0]], [ord("T"), ord("t"), ord(" ")])
    if "ap" in fields:
        names, which = _texts(chars, fields["ap"])
        half = np.array([{"am": 0, "pm": 12}.get(x.lower().replace(".", ""), -1) for x in names])[which]
        good &= (half >= 0) & (h >= 1) & (h <= 12)
        h = h % 12 + half
    midnight = (h == 24) & (mi == 0) & (s == 0) & (fraction == 0)
    good &= (h < 24) | midnight
    m1 = np.clip(m, 1, 12)
    y1 = np.clip(y, 1, 9998)
    start = _days(y1, m1, np.ones_like(d))
    length = _days(y1 + m1 // 12, m1 % 12 + 1, np.ones_like(d)) - start
    good &= d <= length
    seconds = (start + d - 1) * 86_400 + h * 3_600 + mi * 60 + s
    offset = None
    for key in ("off", "off2"):
        if key in fields:
            a, b = fields[key]
            sign = np.where(chars[:, a] == ord("-"), -1, 1)
            colon = [i for i in range(a, b) if (chars[0, i] == ord(":"))]
            cut = colon[0] if colon else (a + 3 if b - a >= 5 else b)
            minutes = _number(chars, (cut + len(colon), b)) if cut < b else 0
            hours = _number(chars, (a + 1, cut))
            good &= (hours <= 18) & (minutes < 60)
            offset = sign * (hours * 3_600 + minutes * 60)
    if "gmt" in fields:
        names, which = _texts(chars, fields["gmt"])
        good &= np.array([x.upper() in ("UTC", "GMT") for x in names])[which]
    if "abbr" in fields:
        names, which = _texts(chars, fields["abbr"])
        known = [zones.ABBREVIATIONS.get(x.upper()) for x in names]
        good &= np.array([k is not None for k in known])[which]
        offset = np.array([(k or 0) * 60 for k in known], dtype=np.int64)[which]
    if offset is not None:
        return (seconds - offset) * 1_000_000 + fraction, good
    if "iana" in fields:
        names, which = _texts(chars, fields["iana"])
    else:
        names, which = np.unique(zone_of_row, return_inverse=True)
    for i, name in enumerate(names):
        rows = np.flatnonzero(which == i)
        seconds[rows], known = zones.local_to_utc(seconds[rows], str(name))
        if not known:
            good[rows] = False
    return seconds * 1_000_000 + fraction, good


def to_instants(texts: pa.Array, tz: pa.Array) -> pa.Array:
    """Microseconds since 1970-01-01 UTC for each text, null where it denotes no instant."""
    texts = pc.utf8_trim_whitespace(texts.cast(pa.string()))
    shapes = pc.replace_substring_regex(pc.replace_substring_regex(texts, r"[0-9]", "9"), r"\p{L}", "a")
    coded = pc.dictionary_encode(shapes)
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out, valid = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    zone_of_row = np.array(tz.cast(pa.string()).fill_null("").to_pylist(), dtype=str)
    values = np.array(texts.to_pylist(), dtype=object)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for code, shape in enumerate(coded.dictionary.to_pylist()):
        fields = _known(shape) if len(shape) <= SHAPE_CHARS else parser(shape)
        if fields is None:
            continue
        rows = order[starts[code] : starts[code + 1]]
        out[rows], valid[rows] = _convert(list(values[rows]), zone_of_row[rows], fields)
    return pa.array(out, mask=~valid)


@F.arrow_udf(T.LongType())
def _instants(texts: pa.Array, tz: pa.Array) -> pa.Array:
    return to_instants(texts, tz)


@F.arrow_udf(T.LongType())
def _local(instants: pa.Array, tz: pa.Array) -> pa.Array:
    known = ~instants.is_null().to_numpy(zero_copy_only=False)
    us = instants.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = us.copy()
    names, which = np.unique(np.array(tz.cast(pa.string()).fill_null("").to_pylist(), dtype=str), return_inverse=True)
    for i, name in enumerate(names):
        rows = np.flatnonzero(which == i)
        out[rows] = zones.utc_to_local(us[rows] // 1_000_000, str(name)) * 1_000_000 + us[rows] % 1_000_000
    return pa.array(out, mask=~known)


def instant_us(text: Column, tz: Column) -> Column:
    """The instant a text denotes, as microseconds since 1970-01-01 UTC.

    ``tz`` is the zone where the text names none; if that is null or unknown, such a text gives null. Units that are
    not written are zero; day before month where both are possible; of a local time that occurs twice the earlier
    instant; a skipped one is read with the offset before the change. Relative, incomplete, impossible, empty and null
    texts give null.
    """
    return _instants(text, tz)


def message_instants(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """``messages`` with ``utc_us``; the chat's zone counts where the text names none.

    Chats are repeated at most by mistake: the smallest zone name of a slug counts.
    """
    return _zoned(messages, chats).withColumn("utc_us", instant_us(F.col("date"), F.col("__tw_tz"))).drop("__tw_chat", "__tw_tz")


def _zoned(messages: DataFrame, chats: DataFrame) -> DataFrame:
    zone = chats.groupBy(F.col("chat_slug").alias("__tw_chat")).agg(F.min("tz_name").alias("__tw_tz"))
    return messages.join(bounded_broadcast(zone), F.col("chat_slug") == F.col("__tw_chat"), "left")


def message_days(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """``messages`` with ``day`` (``yyyy-mm-dd``) and ``clock`` (``hh:mm``) as a clock in the chat's zone shows them.

    Both are null where the date denotes no instant. Where the chat's zone is unknown they are those of UTC.
    """
    rows = _zoned(messages, chats).withColumn("__tw_us", _local(instant_us(F.col("date"), F.col("__tw_tz")), F.col("__tw_tz")))
    minute = F.pmod(F.floor(F.col("__tw_us") / 60_000_000), F.lit(1440))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("__tw_us") / 86_400_000_000).cast("int")).cast("string")
    clock = F.concat(two(F.floor(minute / 60)), F.lit(":"), two(F.pmod(minute, F.lit(60))))
    return rows.withColumn("day", day).withColumn("clock", clock).drop("__tw_chat", "__tw_tz", "__tw_us")

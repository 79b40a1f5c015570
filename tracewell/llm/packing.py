"""Filling fixed-capacity windows with texts: exact-complement hashing over the histogram of lengths.

Windows are planned on counts per length, never on texts: a capacity of C has at most C lengths, whatever the corpus
holds. A window is opened with the longest length left and filled greedily until the gap may be closed exactly. The
lengths that are available are an index of bits, once forwards and once backwards: both laid over each other at a gap
show every pair that fills it, and for each first part of a triple every pair that fills the rest. A combination that
exactly fills the gap is consumed, as often as the counts allow at once. Where no combination fills it, the best fit
takes the residue. Each kind of window is planned in a task of its own; the plan (at most a few rows per length) goes
back to the texts through each text's number within its length.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.ranking import positions
from tracewell.session import checkpoint

PLAN = T.StructType(
    [
        T.StructField("window_name", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("bin", T.LongType()),
    ]
)
#: Kinds of windows that are filled at once; more are refused.
MOST_WINDOWS = 1_000
#: Numbers of one length that are held against the ranges of the plan together.
RANGE_BUCKET = 1_024


class Lengths:
    """Counts of lengths from 1 to ``most``, with an index of those that are available."""

    def __init__(self, counts: dict[int, int], most: int) -> None:
        self.left, self.most = {k: n for k, n in counts.items() if n > 0}, most
        forth, back = bytearray(most // 8 + 1), bytearray(most // 8 + 1)
        for k in self.left:
            forth[k >> 3] |= 1 << (k & 7)
            back[most - k >> 3] |= 1 << (most - k & 7)
        self.forth, self.back = int.from_bytes(forth, "little"), int.from_bytes(back, "little")
        self.items, self.total = sum(self.left.values()), sum(k * n for k, n in self.left.items())

    def take(self, k: int, n: int = 1) -> None:
        self.left[k] -= n
        self.items -= n
        self.total -= n * k
        if not self.left[k]:
            self._flip(k)

    def _flip(self, k: int) -> None:
        self.forth ^= 1 << k
        self.back ^= 1 << self.most - k

    def longest(self, gap: int) -> int:
        """The longest available length of at most ``gap``; 0 if there is none."""
        return max(0, (self.forth & (1 << gap + 1) - 1).bit_length() - 1)

    def pair(self, gap: int) -> list[int] | None:
        both = self.forth & self.back >> self.most - gap
        if not gap & 1 and both >> gap // 2 & 1 and self.left[gap // 2] < 2:
            both ^= 1 << gap // 2
        return [a := both.bit_length() - 1, gap - a] if both else None

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths whose sum is exactly ``gap``."""
        if self.left.get(gap):
            return [gap]
        if found := self.pair(gap):
            return found
        a = gap
        while 3 * (a := self.longest(a - 1)) >= gap:  # the longest of three is at least a third
            if last := self.left[a] == 1:
                self._flip(a)
            self.left[a] -= 1
            found = self.pair(gap - a)
            self.left[a] += 1
            if last:
                self._flip(a)
            if found:
                return [a, *found]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (length -> how many, number of such windows); every item of ``counts`` is used exactly once.

    Lengths are from 1 to ``capacity``. The work depends on the number of different lengths, not on the counts.
    """
    have, out = Lengths(counts, capacity), []
    while longest := have.longest(capacity):
        typical = max(1, have.total // have.items)
        used: Counter[int] = Counter({longest: 1})
        have.take(longest)
        gap = capacity - longest
        while gap:
            if gap <= 4 * typical and (found := have.exact(gap)):
                for k in found:
                    used[k] += 1
                    have.take(k)
                break
            if not (k := have.longest(gap)):
                break
            many = min(have.left[k], max(1, (gap - 3 * typical) // k)) if gap > 4 * typical else 1
            used[k] += many
            have.take(k, many)
            gap -= k * many
        again = min(have.left[k] // n for k, n in used.items())
        for k, n in used.items():
            if again:
                have.take(k, n * again)
        out.append((dict(used), again + 1))
    return out


def plan_rows(window: str, windows: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """The plan as rows: items ``first`` to ``last`` of a length go into windows ``bin``, ``bin`` + 1, ..."""
    rows, taken, bins = [], Counter(), 0
    for used, times in windows:
        for length, n in used.items():
            for _ in range(n):
                start = taken[length] + 1
                rows.append((window, length, start, start + times - 1, bins))
                taken[length] += times
        bins += times
    return rows


def pieces(lengths: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity, id, piece, start, length): what has to be placed, from (id, tokens) and the windows.

    A text that fits is one piece. A longer one is divided into full windows and a rest. Texts without tokens need no
    room and are left out; so are windows without a positive capacity.
    """
    caps = windows.where("capacity_tokens > 0").groupBy("window_name").agg(F.max("capacity_tokens").alias("capacity"))
    caps = [(r.window_name, r.capacity) for r in caps.orderBy("window_name").limit(MOST_WINDOWS + 1).collect()]
    if len(caps) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} kinds of windows")
    listed = F.array(*(F.struct(F.lit(n).alias("window_name"), F.lit(c).alias("capacity")) for n, c in caps)) if caps else F.array().cast("array<struct<window_name:string,capacity:bigint>>")
    rows = lengths.where("tokens > 0").select("id", "tokens", F.inline(listed))
    last = F.floor((F.col("tokens") - 1) / F.col("capacity"))
    rows = rows.select("window_name", "capacity", "id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return rows.select("window_name", "capacity", "id", "piece", start.alias("start"), F.least("capacity", F.col("tokens") - start).alias("length"))


def pack(lengths: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, window_no, id, piece, start, length): each piece in exactly one window.

    Windows are numbered from 0 per window_name. Ties between texts of one length are settled by id. An id that is
    repeated counts as often as it occurs.
    """
    placed = positions(pieces(checkpoint(lengths), windows), ["window_name", "length"], ["id", "piece"], "number")
    placed = checkpoint(placed)
    histogram = placed.groupBy("window_name", "capacity", "length").agg(F.count("*").alias("n"))

    def planned(rows):  # at most one row per length up to the capacity
        import pandas as pd

        windows = plan(dict(zip(rows["length"].tolist(), rows["n"].tolist())), int(rows["capacity"].iloc[0]))
        return pd.DataFrame(plan_rows(rows["window_name"].iloc[0], windows), columns=PLAN.names)

    plans = checkpoint(histogram.groupBy("window_name", "capacity").applyInPandas(planned, PLAN))
    bucket = lambda c: F.floor(F.col(c) / RANGE_BUCKET)
    plans = plans.select(F.col("window_name").alias("_w"), F.col("length").alias("_l"), "first", "last", "bin", F.explode(F.sequence(bucket("first"), bucket("last"))).alias("_b"))
    here = (F.col("window_name") == F.col("_w")) & (F.col("length") == F.col("_l")) & (bucket("number") == F.col("_b")) & F.col("number").between(F.col("first"), F.col("last"))
    return placed.join(plans.hint("merge"), here).select(
        "window_name", (F.col("bin") + F.col("number") - F.col("first")).alias("window_no"), "id", "piece", "start", "length"
    )


def fill(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, windows, pieces, tokens, fill): how full the windows are."""
    caps = windows.groupBy("window_name").agg(F.max("capacity_tokens").alias("capacity"))
    sums = packed.groupBy("window_name").agg((F.max("window_no") + 1).alias("windows"), F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
    return sums.join(caps, "window_name").select("window_name", "windows", "pieces", "tokens", (F.col("tokens") / (F.col("windows") * F.col("capacity"))).alias("fill"))

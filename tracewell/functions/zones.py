"""Zone transition tables, built once per process from the installed time zone database."""

from __future__ import annotations

import importlib.metadata
import importlib.resources
import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path

import numpy as np

UTC = timezone.utc
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: The rule behind the last listed transition repeats with the calendar: every 400 years, a whole number of weeks.
CYCLE = 146_097 * 86_400
#: Rules change offsets twice a year; they are sought in steps of this size.
STEP = 5 * 86_400

#: Offsets in minutes of the zone abbreviations that are read in texts.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "YEKT": 300, "IST": 330, "JST": 540, "AWST": 480, "ACST": 570,
    "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}


def version() -> str:
    """The release of the time zone database behind the tables."""
    for root in zoneinfo.TZPATH:
        path = Path(root, "tzdata.zi")
        if path.exists():
            with path.open() as f:
                return f.readline().replace("# version", "").strip()
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


def _listed(name: str) -> list[int]:
    """The transitions (UTC seconds) that the database lists for a zone, from the 64-bit part of its file."""
    data = b""
    for root in zoneinfo.TZPATH:
        if (path := Path(root, name)).is_file():
            data = path.read_bytes()
            break
    else:
        data = importlib.resources.files("tzdata.zoneinfo").joinpath(name).read_bytes()
    head = struct.Struct(">4s1s15x6l")
    _, kind, *counts = head.unpack_from(data)
    at, letter = head.size, "l"
    if kind >= b"2":  # the second part repeats the first one with wider numbers
        utc, std, leap, times, types, chars = counts
        at += times * 5 + types * 6 + chars + leap * 8 + std + utc
        counts, at, letter = head.unpack_from(data, at)[2:], at + head.size, "q"
    return list(struct.unpack_from(f">{counts[3]}{letter}", data, at))


@lru_cache(maxsize=1024)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None] | None:
    """(local thresholds, instants, offsets, end of the list) in seconds; offsets has one element more. None for an unknown zone.

    A local second below threshold i is read with offset i. The threshold is the later of the two local readings of
    the transition: a local time that occurs twice keeps the offset before the change, which is the earlier instant,
    and one that is skipped is read with the offset that was in force before the change. From the end of the list on,
    what the table says of the 400 years after it repeats for ever; where no rule follows the list, the end is None.
    """
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def offset(second: int) -> int:
        return int((EPOCH + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    least = int((datetime(2, 1, 1, tzinfo=UTC) - EPOCH).total_seconds())
    changes = [t for t in _listed(name) if t > least]
    last = max([*changes, 0])
    ahead = range(last + STEP, last + 2 * 366 * 86_400, STEP)
    ruled = any(offset(t) != offset(last + 1) for t in ahead)
    if ruled:
        low, before = last + 1, offset(last + 1)
        while low < last + CYCLE + 366 * 86_400:
            high = low + STEP
            after = offset(high)
            if after != before:
                a, b = low, high
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if offset(mid) == before else (a, mid)
                changes.append(b)
            low, before = high, after
    thresholds, offsets = [], [offset(changes[0] - 1 if changes else 0)]
    for t in changes:
        thresholds.append(t + max(offsets[-1], offset(t)))
        offsets.append(offset(t))
    return np.array(thresholds, dtype=np.int64), np.array(changes, dtype=np.int64), np.array(offsets, dtype=np.int64), last + 180 * 86_400 if ruled else None


def local_to_utc(seconds: np.ndarray, name: str) -> tuple[np.ndarray, bool]:
    """Local seconds to UTC seconds through the table of a zone; False if the zone is unknown."""
    found = transitions(name)
    if found is None:
        return seconds, False
    thresholds, _, offsets, end = found
    return seconds - offsets[np.searchsorted(thresholds, _inside(seconds, end), side="right")], True


def utc_to_local(seconds: np.ndarray, name: str) -> np.ndarray:
    """UTC seconds to what a clock in the zone shows; as they are if the zone is unknown."""
    found = transitions(name)
    if found is None:
        return seconds
    _, changes, offsets, end = found
    return seconds + offsets[np.searchsorted(changes, _inside(seconds, end), side="right")]


def _inside(seconds: np.ndarray, end: int | None) -> np.ndarray:
    return seconds if end is None else np.where(seconds > end, end + (seconds - end) % CYCLE, seconds)

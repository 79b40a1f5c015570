"""Clean keys: message numbers, record ids, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the data as a Java character class: ASCII controls, NEL and every Unicode separator.
SPACE = r"[\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space at both ends (Unicode, not only blanks)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def record_id(c: Column) -> Column:
    """An id as it is compared: stripped, lower case; blank becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def message_number(c: Column) -> Column:
    """The message's number in its chat from any spelling of ``msg_id`` or ``reply_to``.

    Accepted: ``12``, ``0012``, ``12.0``, ``slug:12`` with white space anywhere around the parts, whatever the number of
    leading zeros. Everything else, and numbers beyond 64 bits with sign, which no identifier has, gives null.
    """
    digits = F.regexp_extract(c, rf"^{SPACE}*(?:[^:]*:)?{SPACE}*0*([0-9]{{1,19}})(?:\.0*)?{SPACE}*$", 1)
    return F.nullif(digits, F.lit("")).try_cast("long")


def day(c: Column) -> Column:
    """A day with or without padding; missing or impossible gives null."""
    clean = strip(c)
    shaped = F.regexp_extract(clean, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$", 1)
    return F.try_to_date(F.nullif(shaped, F.lit("")), "yyyy-M-d")

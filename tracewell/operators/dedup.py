"""Messages delivered more than once: exact quotient hashing.

Each message number is a fixed-width 64-bit identifier. A keyed Feistel network permutes it, so that nothing is lost and
no two identifiers of a chat collide. The high bits of the permuted value are the quotient and name the shard; the low
bits are the remainder and are stored complete, together with the chat. (chat, quotient, remainder) can be turned back
into (chat, number), so equality in a shard is equality of messages and no false match exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.keys import message_number

ROUNDS = 3
#: Bits of the quotient: 4,096 shards.
QUOTIENT_BITS = 12
LOW = 0xFFFFFFFF


def permute(number: Column, key: Column) -> Column:
    """A bijection of 64-bit numbers for every key (Feistel network on two halves of 32 bits)."""
    left, right = F.shiftrightunsigned(number, 32), number.bitwiseAND(F.lit(LOW))
    for r in range(ROUNDS):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, key, F.lit(r)).bitwiseAND(F.lit(LOW)))
    return F.shiftleft(left, 32).bitwiseOR(right)


def unpermute(value: Column, key: Column) -> Column:
    """The inverse of :func:`permute`: the proof that a quotient with its remainder stands for one number."""
    left, right = F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(LOW))
    for r in reversed(range(ROUNDS)):
        left, right = right.bitwiseXOR(F.xxhash64(left, key, F.lit(r)).bitwiseAND(F.lit(LOW))), left
    return F.shiftleft(left, 32).bitwiseOR(right)


def quotient_keys(df: DataFrame, chat: str, number: str) -> DataFrame:
    """Adds ``quotient`` and ``remainder`` of each identifier."""
    return (
        df.withColumn("_p", permute(F.col(number), F.col(chat)))
        .withColumn("quotient", F.shiftrightunsigned("_p", 64 - QUOTIENT_BITS).cast("int"))
        .withColumn("remainder", F.col("_p").bitwiseAND(F.lit((1 << (64 - QUOTIENT_BITS)) - 1)))
        .drop("_p")
    )


def kept_rows(messages: DataFrame, *carry: Column) -> DataFrame:
    """One row per message: chat_slug, msg_no, row_id, received_at of the kept row, and ``carry`` of that row.

    Kept is the row with the smallest ``received_at``, then the smallest ``row_id``. Rows whose ``msg_id`` is null or
    no number are no messages. An unknown ``received_at`` comes after every known one; a null chat is a chat of its
    own. The aggregation combines before the shuffle, so a message that fills a third of the table costs one row per
    map task; a shard's table holds only chat, remainder and the best row so far.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    rows = messages.select(
        "chat_slug",
        message_number(F.col("msg_id")).alias("_n"),
        F.col("received_at").isNull().alias("_late"),
        "received_at",
        "row_id",
        *(c.alias(n) for c, n in zip(carry, names)),
    )
    rows = quotient_keys(rows.where("_n is not null"), "chat_slug", "_n")
    best = F.min(F.struct("_late", "received_at", "row_id", "_n", *names)).alias("_best")
    table = rows.groupBy("quotient", "remainder", "chat_slug").agg(best)
    outer = [messages.select(c).columns[0] for c in carry]
    return table.select(
        "chat_slug",
        F.col("_best._n").alias("msg_no"),
        "_best.row_id",
        "_best.received_at",
        *(F.col(f"_best.{n}").alias(o) for n, o in zip(names, outer)),
    )


def deduplicate(messages: DataFrame) -> DataFrame:
    """``messages`` with exactly one row of each message; rows without a number stay as they are.

    The join runs on the unique ``row_id``, never on the message, so no hot message reaches one task. A row_id that is
    itself repeated is kept once for each repetition of the kept row.
    """
    kept = kept_rows(messages).select(F.col("row_id").alias("__tw_kept"))
    number = message_number(F.col("msg_id"))
    joined = messages.join(kept, F.col("row_id") == F.col("__tw_kept"), "left")
    return joined.where(number.isNull() | F.col("__tw_kept").isNotNull()).drop("__tw_kept")


def redundant_rows(messages: DataFrame) -> DataFrame:
    """The row_id of every row with a message number that is not the kept row of its message."""
    kept = kept_rows(messages).select("row_id")
    rows = messages.where(message_number(F.col("msg_id")).isNotNull()).select("row_id")
    return rows.join(kept, "row_id", "left_anti")

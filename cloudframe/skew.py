"""Hot-key handling shared by the joins of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.lineage import cut_lineage

C = F.col
# A key is split as soon as one side holds more than this many rows of it.
ROWS_PER_TASK = 100_000
# A table of hot keys up to this many rows is broadcast; a larger one is joined by key.
MOST_BROADCAST = 100_000


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys that hold more than ``rows_per_task`` rows, with the number of parts ``_parts`` to cut them into."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(C("_rows") > rows_per_task)
    return counts.select(*keys, F.ceil(C("_rows") / F.lit(float(rows_per_task))).cast("int").alias("_parts"))


def salted(left: DataFrame, right: DataFrame, keys: list[str], left_id: Column, right_id: Column,
           rows_per_task: int | None = None, *, count: str = "right") -> tuple[DataFrame, DataFrame, list[str]]:
    """Add salts so that an inner equi-join on ``keys`` plus salts yields every original pair exactly once.

    Every key with more than ``rows_per_task`` rows on a counted side is cut: the rows of that side into parts by a hash
    of their ids, each of which meets all rows of the other side's parts in a task of its own.  ``count`` names the side
    that can be crowded: ``right`` (also enough where both sides hold the same points), ``left`` or ``both``.  The hot
    keys are counted once, into the checkpoint folder; without any the join stays a plain one.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    on = list(keys)
    for side in ("right", "left"):
        if count not in (side, "both"):
            continue
        hot = cut_lineage(hot_keys(right if side == "right" else left, keys, rows_per_task))
        number = hot.count()
        if not number:
            continue
        hot = F.broadcast(hot) if number <= MOST_BROADCAST else hot
        parts = F.coalesce(C("_parts"), F.lit(1))
        name = f"_salt_{side}"
        every_part = F.explode(F.sequence(F.lit(0), parts - 1))
        left_part = F.pmod(F.xxhash64(left_id), parts).cast("int") if side == "left" else every_part
        right_part = F.pmod(F.xxhash64(right_id), parts).cast("int") if side == "right" else every_part
        left = left.join(hot, keys, "left").withColumn(name, left_part).drop("_parts")
        right = right.join(hot, keys, "left").withColumn(name, right_part).drop("_parts")
        on.append(name)
    return left, right, on


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with a ``table`` of one row per key, however many rows share a key (``how``: inner or left).

    The table is made once, into the checkpoint folder.  Up to ``MOST_BROADCAST`` rows of it go to every task and the rows
    stay where they are; a larger table is joined by key, and keys with very many rows are cut.
    """
    table = cut_lineage(table)
    if table.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), keys, how)
    hot = cut_lineage(hot_keys(rows, keys, ROWS_PER_TASK))
    number = hot.count()
    if not number:
        return rows.join(table, keys, how)
    hot = F.broadcast(hot) if number <= MOST_BROADCAST else hot
    parts = F.coalesce(C("_parts"), F.lit(1))
    # Each part has the table's row, so any salt will do; copies of a row may share one.
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    spread = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


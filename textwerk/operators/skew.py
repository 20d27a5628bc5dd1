"""Joins and pairings in which one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: At most so many keys are treated as heavy; every other key has less than one in so many rows.
HEAVIEST = 256
#: A key with fewer rows is never heavy, as a task holds so many with ease.
LEAST_ROWS = 20_000
#: Rows of a block when the rows of one key are paired.
BLOCK = 4096


def heavy_keys(rows: DataFrame, key: str, least: int | None = None) -> list:
    """The heaviest keys, counted exactly from partial aggregates: at most ``HEAVIEST``, each with ``least`` rows or more."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= (least or LEAST_ROWS))
    return [r[0] for r in counts.orderBy(F.desc("n")).limit(HEAVIEST).collect()]


def split_join(left: DataFrame, right: DataFrame, on: str, heavy: Sequence, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` where ``right`` has few rows a key and ``left`` may have very many.

    Rows with one of the ``heavy`` keys (at most ``HEAVIEST``) meet a broadcast of the right rows of these keys and are not shuffled by the
    key; the others are joined as usual. ``how`` is inner, left, left_semi or left_anti.
    """
    if not heavy:
        return left.join(right, on, how)
    is_heavy = F.col(on).isin(list(heavy))
    usual = left.where(~F.coalesce(is_heavy, F.lit(False))).join(right.where(~is_heavy), on, how)
    return usual.union(left.where(is_heavy).join(F.broadcast(right.where(is_heavy)), on, how).select(*usual.columns))


def dealt(rows: DataFrame, key: str, row_id: str, block: int | None = None) -> DataFrame:
    """The rows with ``n_rows`` and ``n_blocks`` of their key and their own ``block``, so that about ``block`` rows share one."""
    size = block or BLOCK
    counts = rows.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    known = split_join(rows, counts, key, heavy_keys(rows, key), "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(1)))
    blocks = F.ceil(F.col("n_rows") / size).cast("int")
    return known.withColumn("n_blocks", blocks).withColumn("block", F.pmod(F.xxhash64(row_id), blocks).cast("int"))


def pairs_of(rows: DataFrame, key: str, row_id: str, extra: Sequence[str] = ()) -> DataFrame:
    """(a_x, b_x for the id and each extra column) of every two of the :func:`dealt` rows with the same key, the smaller id first.

    Each two blocks of a key meet in a cell of their own, so that no task gets more than two blocks at a
    time, however many rows the key has. The ids are distinct.
    """
    cells = rows.where("n_rows > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    cells = cells.select(key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", row_id, *extra)
    a, b = (cells.select(key, "lo", "hi", F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in (row_id, *extra)]) for s in "ab")
    met = a.join(b, [key, "lo", "hi"]).where((F.col("lo") == F.col("hi")) | (F.col("a_block") != F.col("b_block"))).where(F.col(f"a_{row_id}") < F.col(f"b_{row_id}"))
    return met.select(*[f"{s}_{c}" for s in "ab" for c in (row_id, *extra)])

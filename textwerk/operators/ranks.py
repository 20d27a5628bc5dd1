"""Ranks, rank correlation, quantile bins and step-down adjustment.

Ranks over a whole table come from counts of its distinct values, not from one sorted window: values are counted by shuffle, and
running counts use range blocks, so that no task holds the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textwerk.operators.durable import Workspace

#: Blocks for running counts over the whole table: each holds a range of values.
BLOCKS = 64


def average_ranks(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n, rank): every distinct value of a group with its count and average rank; nulls are left out."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    if by:
        before = F.sum("n").over(Window.partitionBy(*by).orderBy("value")) - F.col("n")
        return counts.select(*by, F.col("value").alias(value), "n", (before + (F.col("n") + 1) / 2).alias("rank"))
    parts = counts.repartitionByRange(BLOCKS, "value").withColumn("_part", F.spark_partition_id())
    parts = Workspace(values.sparkSession).save(parts)  # block numbers must not change between the two reads
    sizes = parts.groupBy("_part").agg(F.sum("n").alias("size"))
    starts = sizes.select("_part", (F.sum("size").over(Window.orderBy("_part")) - F.col("size")).alias("start"))  # at most BLOCKS rows
    inner = F.sum("n").over(Window.partitionBy("_part").orderBy("value")) - F.col("n")
    return parts.withColumn("_before", inner).join(F.broadcast(starts), "_part").select(F.col("value").alias(value), "n", (F.col("start") + F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(pairs: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, rho) of rows with both values; null where a value is constant or there are fewer than two rows.

    Ranks are joined to the counts of distinct (x, y), which for an ordinal y are far fewer than the rows.
    """
    cells = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("w"))
    expanded = Workspace(pairs.sparkSession).save(cells.select(*by, x, y, "w"))
    rx = _weighted_ranks(expanded, x, by, "rx")
    ry = _weighted_ranks(expanded, y, by, "ry")
    ranked = expanded.join(rx, [*by, x]).join(ry, [*by, y])
    w = F.col("w")
    m = ranked.groupBy(*by).agg(F.sum("w").alias("n"), (F.sum(w * F.col("rx")) / F.sum("w")).alias("mx"), (F.sum(w * F.col("ry")) / F.sum("w")).alias("my"), (F.sum(w * F.col("rx") * F.col("ry")) / F.sum("w")).alias("mxy"), (F.sum(w * F.col("rx") * F.col("rx")) / F.sum("w")).alias("mxx"), (F.sum(w * F.col("ry") * F.col("ry")) / F.sum("w")).alias("myy"))
    spread = F.sqrt((F.col("mxx") - F.col("mx") * F.col("mx")) * (F.col("myy") - F.col("my") * F.col("my")))
    return m.select(*by, "n", F.when((F.col("n") > 1) & (spread > 1e-9), (F.col("mxy") - F.col("mx") * F.col("my")) / spread).alias("rho"))


def _weighted_ranks(cells: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    counts = cells.groupBy(*by, value).agg(F.sum("w").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(value)) - F.col("_n")
    return counts.select(*by, value, (before + (F.col("_n") + 1) / 2).alias(name))


def quantile_bins(rows: DataFrame, value: str, q: int = 4, by: Sequence[str] = (), name: str = "bin") -> DataFrame:
    """``name`` from 1: right-closed bins between linearly interpolated quantiles, equal edges merged; a constant column is all 1.

    The quantiles are exact; each group's edges are one row.
    """
    points = F.array(*[F.lit(k / q) for k in range(q + 1)])
    edges = rows.groupBy(*by).agg(F.percentile(value, points).alias("_edges"))
    joined = rows.join(F.broadcast(edges), list(by)) if by else rows.crossJoin(F.broadcast(edges))
    below = F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col(value)))
    return joined.withColumn(name, F.greatest(F.lit(1), below)).drop("_edges")


def holm(rows: DataFrame, p: str = "p", name: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment over the rows, a family of tests and so a small table; null p stays null and is not counted."""
    tested = rows.where(F.col(p).isNotNull())
    m = F.count("*").over(Window.partitionBy())
    step = F.row_number().over(Window.orderBy(p))
    ordered = tested.withColumn("_m", m).withColumn("_step", step)
    adjusted = ordered.withColumn(name, F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_step") + 1) * F.col(p))).over(Window.orderBy("_step"))).drop("_m", "_step")
    return adjusted.unionByName(rows.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def share_of(column: str, by: Sequence[str]) -> Column:
    """A column's share of its group's total."""
    return F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(*by)))


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in the order; Spark limits ranks within each task before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")

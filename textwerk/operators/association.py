"""Contingency-table statistics over long cells (stratum, x, y, n).

One aggregation of the data gives the cells; all statistics are computed from them. ``by`` names the stratum columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textwerk.operators.durable import Workspace


def cells_of(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, y, n) counts of rows with both values.

    The cells are written once, since every statistic reads them several times and the data behind them should be read only once.
    """
    counted = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    return Workspace(rows.sparkSession).save(counted)


def grid(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every (x, y) of a stratum, absent ones with n = 0; with row, column and overall totals ``r``, ``c``, ``t``."""
    rows = cells.groupBy(*by, "x").agg(F.sum("n").alias("r"))
    columns = cells.groupBy(*by, "y").agg(F.sum("n").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("t"))
    full = rows.join(columns, list(by)) if by else rows.crossJoin(columns)
    full = full.join(total, list(by)) if by else full.crossJoin(total)
    return full.join(cells, [*by, "x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected() -> Column:
    """Expected count of a grid row."""
    return F.col("r") * F.col("c") / F.col("t")


def residuals(full: DataFrame) -> DataFrame:
    """The grid with expected counts, their ratio to the counts, and adjusted standardised residuals (0 where undefined)."""
    e = expected()
    spread = F.sqrt(e * (1 - F.col("r") / F.col("t")) * (1 - F.col("c") / F.col("t")))
    return full.withColumn("expected", e).withColumn("obs_over_exp", F.try_divide(F.col("n"), e)).withColumn("std_residual", F.when(spread > 0, (F.col("n") - e) / spread).otherwise(F.lit(0.0)))


def chi_square(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, rows, columns, chi2, dof, v, v_uncorrected): Pearson's statistic without continuity correction, and Cramér's V.

    ``v`` has Bergsma's correction of bias; both are null for a table with less than two rows or columns.
    """
    full = grid(cells, by)
    d = F.col("n") - expected()
    s = full.groupBy(*by).agg(F.max("t").alias("n"), F.count_distinct("x").alias("rows"), F.count_distinct("y").alias("columns"), F.sum(d * d / expected()).alias("chi2"))
    return with_v(s)


def with_v(s: DataFrame) -> DataFrame:
    """Cramér's V, corrected and not, from n, rows, columns and chi2."""
    n, r, k = F.col("n"), F.col("rows"), F.col("columns")
    phi = F.try_divide(F.col("chi2"), n)
    phi_c = F.greatest(F.lit(0.0), phi - F.try_divide((k - 1) * (r - 1), n - 1))
    r_c, k_c = r - F.try_divide((r - 1) * (r - 1), n - 1), k - F.try_divide((k - 1) * (k - 1), n - 1)
    low = F.least(k_c - 1, r_c - 1)
    plain = F.least(r - 1, k - 1)
    v = F.when(plain > 0, F.when((n > 1) & (low > 0), F.sqrt(phi_c / low)).otherwise(F.lit(0.0)))
    return s.withColumn("dof", (r - 1) * (k - 1)).withColumn("v", v).withColumn("v_uncorrected", F.when(plain > 0, F.sqrt(phi / plain)))


def information(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., h_x, h_y, mi, u_x_given_y, u_y_given_x, nmi): entropies in nats, Theil's U both ways (0 where the entropy is 0), and
    mutual information normalised by the mean entropy (1 where both are 0)."""
    total = cells.groupBy(*by).agg(F.sum("n").alias("t"))
    join = lambda a, b: a.join(F.broadcast(b), list(by)) if by else a.crossJoin(F.broadcast(b))
    entropy = lambda d, name: join(d, total).groupBy(*by).agg(F.sum(-F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t"))).alias(name))
    hx = entropy(cells.groupBy(*by, "x").agg(F.sum("n").alias("n")), "h_x")
    hy = entropy(cells.groupBy(*by, "y").agg(F.sum("n").alias("n")), "h_y")
    hxy = entropy(cells, "h_xy")
    out = join(join(hx, hy), hxy).withColumn("mi", F.greatest(F.lit(0.0), F.col("h_x") + F.col("h_y") - F.col("h_xy")))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("mi") / F.col(d)).otherwise(F.lit(0.0))
    mean = (F.col("h_x") + F.col("h_y")) / 2
    return out.select(*by, "h_x", "h_y", "mi", ratio("h_x").alias("u_x_given_y"), ratio("h_y").alias("u_y_given_x"), F.when(mean > 0, F.col("mi") / mean).otherwise(F.lit(1.0)).alias("nmi"))


def kruskal(cells: DataFrame, rank: str = "x", group: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, groups, h, epsilon2) with tie correction, of the ordinal ``rank`` over the groups of the cells.

    ``h`` and ``epsilon2`` are null for fewer than two groups, ``h`` also where all values are equal; ``epsilon2`` is 0 where n does not exceed the number of groups.
    """
    from pyspark.sql import Window

    values = cells.groupBy(*by, rank).agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.partitionBy(*by).orderBy(rank)) - F.col("m")
    ranked = values.select(*by, rank, (before + (F.col("m") + 1) / 2).alias("rk"))
    ties = values.groupBy(*by).agg(F.sum("m").alias("total"), F.sum((F.col("m") * F.col("m") * F.col("m") - F.col("m")).cast("double")).alias("ties"))
    sums = cells.join(ranked, [*by, rank]).groupBy(*by, group).agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("rk")).alias("s"))
    inner = sums.groupBy(*by).agg(F.count("*").alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"))
    out = inner.join(ties, list(by)) if by else inner.crossJoin(ties)
    n = F.col("total").cast("double")
    fix = 1 - F.try_divide(F.col("ties"), n * n * n - n)
    h = F.when((F.col("groups") >= 2) & (fix > 0), (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / fix)
    eps = F.when(F.col("groups") >= 2, F.when(n > F.col("groups"), F.greatest(F.lit(0.0), (F.col("h") - F.col("groups") + 1) / (n - F.col("groups")))).otherwise(F.lit(0.0)))
    return out.withColumn("h", h).select(*by, F.col("total").alias("n"), "groups", "h", eps.alias("epsilon2"))


def mantel_haenszel(rows: DataFrame, level: str, topic: str, stratum: str) -> DataFrame:
    """(level, stratum, topic, n, observed, expected, total, members): per stratum and level the counts that the general
    Cochran-Mantel-Haenszel statistic is summed from; strata with one level, one row, or no or only members of the level are left out."""
    cells = cells_of(rows, level, topic, [stratum])
    topics = cells.groupBy(stratum, "y").agg(F.sum("n").alias("n"))
    totals = cells.groupBy(stratum).agg(F.sum("n").alias("total"), F.count_distinct("x").alias("levels"))
    members = cells.groupBy(stratum, "x").agg(F.sum("n").alias("members"))
    usable = members.join(F.broadcast(totals), stratum).where("levels > 1 and total > 1 and members < total")
    full = usable.join(topics, stratum).join(cells.select(stratum, "x", "y", F.col("n").alias("observed")), [stratum, "x", "y"], "left")
    return full.select(F.col("x").alias("level"), F.col(stratum).alias("stratum"), F.col("y").alias("topic"), "n", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("n") * F.col("members") / F.col("total")).alias("expected"), "total", "members")


def dominant(cells: DataFrame, by: str = "y", value: str = "x") -> DataFrame:
    """(by, n, dominant, share): the most frequent value of each group, ties by value."""
    sums = cells.groupBy(by, value).agg(F.sum("n").alias("n"))
    return sums.groupBy(by).agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("m")).select(by, "n", F.col("m.v").alias("dominant"), (-F.col("m.k") / F.col("n")).alias("share"))

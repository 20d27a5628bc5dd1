"""Classification metrics from confusion cells (by..., y_true, y_pred, n) of level ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textwerk.operators.durable import Workspace


def confusion(predictions: DataFrame, by: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Counts of each pair of true and predicted rank, written once; rows without either are left out."""
    counted = predictions.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))
    return Workspace(predictions.sparkSession).save(counted)


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., level, support, predicted_n, precision, recall, f1) of every true or predicted level; 0 where undefined."""
    true = cells.groupBy(*by, F.col("y_true").alias("level")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    pred = cells.groupBy(*by, F.col("y_pred").alias("level")).agg(F.sum("n").alias("predicted_n"))
    both = true.join(pred, [*by, "level"], "full").na.fill(0, ["support", "hit", "predicted_n"])
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select(*by, "level", "support", "predicted_n", rate(F.col("hit"), F.col("predicted_n")).alias("precision"), rate(F.col("hit"), F.col("support")).alias("recall"), rate(2 * F.col("hit"), F.col("support") + F.col("predicted_n")).alias("f1"))


def summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, accuracy, adjacent_accuracy, macro_f1, weighted_f1, qwk).

    Adjacent accuracy uses ranks; the weights of quadratic kappa use positions among the levels that are present, so that a gap in the
    levels counts as one step. Kappa is null for a single level.
    """
    simple = cells.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), (F.sum(F.when(F.abs(F.col("y_true") - F.col("y_pred")) <= 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("adjacent_accuracy"))
    f = per_class(cells, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    join = lambda a, b: a.join(b, list(by)) if by else a.crossJoin(b)
    return join(join(simple, f), kappa(cells, by))


def kappa(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., qwk) with quadratic weights over positions of present levels."""
    levels = cells.select(*by, F.explode(F.array("y_true", "y_pred")).alias("level")).distinct()
    at = levels.withColumn("at", F.dense_rank().over(Window.partitionBy(*by).orderBy("level")))  # a handful of levels
    t, p = at.withColumnsRenamed({"level": "y_true", "at": "i"}), at.withColumnsRenamed({"level": "y_pred", "at": "j"})
    placed = cells.join(t, [*by, "y_true"]).join(p, [*by, "y_pred"])
    join = lambda a, b: a.join(b, list(by)) if by else a.crossJoin(b)
    seen = placed.groupBy(*by).agg(F.sum(F.col("n") * F.pow(F.col("i") - F.col("j"), F.lit(2.0))).alias("o"), F.sum("n").alias("t"))
    rows = placed.groupBy(*by, "i").agg(F.sum("n").alias("r"))
    columns = placed.groupBy(*by, "j").agg(F.sum("n").alias("c"))
    chance = join(rows, columns).groupBy(*by).agg(F.sum(F.col("r") * F.col("c") * F.pow(F.col("i") - F.col("j"), F.lit(2.0))).alias("e"))
    return join(seen, chance).select(*by, (1 - F.try_divide(F.col("o") * F.col("t"), F.col("e"))).alias("qwk"))


def calibration(score: Column, floor: float, ceiling: float) -> Column:
    """Where a score lies between a floor (0) and a ceiling (1); null if they are equal."""
    return (score - floor) / (ceiling - floor) if ceiling != floor else F.lit(None).cast("double")

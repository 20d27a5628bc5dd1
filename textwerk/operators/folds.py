"""Cross-validation folds: by group, stratified, or both. All are functions of ids and a seed, not of the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Groups that are dealt one by one, largest first; the others are dealt by hash order.
LARGE = 1000
BUCKETS = 4096


def stratified_folds(rows: DataFrame, level: str = "cefr_level", row_id: str = "row_id", k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` of each row so that every level is spread evenly: hash buckets of a level are cut at equal row counts."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(BUCKETS)).cast("int")
    placed = rows.withColumn("_b", h)
    load = placed.groupBy(level, "_b").agg(F.count("*").alias("n"))  # at most levels x BUCKETS rows
    w = Window.partitionBy(level).orderBy("_b")
    cut = load.withColumn("_fold", F.floor((F.sum("n").over(w) - F.col("n") / 2) * k / F.sum("n").over(Window.partitionBy(level))).cast("int")).select(level, "_b", "_fold")
    return placed.join(F.broadcast(cut), [level, "_b"]).withColumn("fold", F.least(F.col("_fold"), F.lit(k - 1))).drop("_b", "_fold")


def _greedy(groups: list[tuple[str, dict[str, int]]], start: list[dict[str, int]]) -> dict[str, int]:
    """Largest groups first, each to the fold that leaves level counts most even, then rows."""
    out = {}
    for name, counts in sorted(groups, key=lambda g: (-sum(g[1].values()), g[0])):
        best = min(range(len(start)), key=lambda f: (sum((start[f].get(v, 0) + n) ** 2 - start[f].get(v, 0) ** 2 for v, n in counts.items()), sum(start[f].values()), f))
        out[name] = best
        for v, n in counts.items():
            start[best][v] = start[best].get(v, 0) + n
    return out


def grouped_folds(rows: DataFrame, group: str = "cv_group", level: str | None = "cefr_level", k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` of each row, one for all rows of a group, levels spread as evenly as groups allow.

    The ``LARGE`` largest groups come to the driver and are dealt one by one; all others, none larger than these, are dealt by hash order within
    the level most of their rows have. With ``level`` None only rows count.
    """
    spark = rows.sparkSession
    lv = F.col(level) if level else F.lit("all")
    counts = rows.groupBy(F.col(group).alias("g"), lv.alias("v")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy("g").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("k"), "v")).alias("m")).select("g", "size", F.col("m.v").alias("v"))
    top = [r["g"] for r in sizes.orderBy(F.desc("size"), "g").limit(LARGE).collect()]
    if not top:
        return rows.withColumn("fold", F.lit(None).cast("int"))
    names = spark.createDataFrame([(g,) for g in top], f"g {dict(sizes.dtypes)['g']}")
    big: dict = {}
    for r in counts.join(F.broadcast(names), "g").collect():
        big.setdefault(r["g"], {})[r["v"]] = r["n"]
    dealt = _greedy(list(big.items()), [{} for _ in range(k)])
    table = spark.createDataFrame([(g, f) for g, f in dealt.items()], f"g {dict(sizes.dtypes)['g']}, big_fold int")
    small = sizes.join(F.broadcast(names), "g", "left_anti").withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "g"), F.lit(BUCKETS)).cast("int"))
    load = small.groupBy("v", "b").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("v").orderBy("b")
    cut = load.withColumn("small_fold", F.least(F.lit(k - 1), F.floor((F.sum("n").over(w) - F.col("n") / 2) * k / F.sum("n").over(Window.partitionBy("v"))).cast("int"))).select("v", "b", "small_fold")
    rest = small.join(F.broadcast(cut), ["v", "b"]).select("g", "small_fold")
    return rows.join(F.broadcast(table), rows[group] == table["g"], "left").drop("g").join(rest, rows[group] == rest["g"], "left").drop("g").withColumn("fold", F.coalesce("big_fold", "small_fold")).drop("big_fold", "small_fold")

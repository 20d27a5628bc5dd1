"""Groups of linked records, validation families and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textwerk.operators.clean import strip
from textwerk.operators.durable import Workspace
from textwerk.operators.skew import LEAST_ROWS, heavy_keys, split_join


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, label) with the smallest vertex of each component, for string or number vertices that have a link.

    Each round points every vertex to the smallest of its neighbourhood in a pseudo-random order, follows pointers to their end, and contracts the links.
    A vertex with most of the links, or a label with most of the vertices, meets a broadcast instead of being shuffled to one task.
    """
    ws = Workspace(edges.sparkSession)

    def links_of(df: DataFrame, x: str, y: str) -> DataFrame:
        return ws.save(df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct())

    def heavy(df: DataFrame, key: str, n: int) -> list:
        return heavy_keys(df, key) if n >= LEAST_ROWS else []

    def renamed(df: DataFrame, labels: DataFrame, key: str, n: int) -> DataFrame:
        """``df`` with the column ``key`` replaced by its label."""
        to = labels.select(F.col("vertex").alias(key), F.col("label").alias("_to"))
        return split_join(df, to, key, heavy(df, key, n), "left").withColumn(key, F.coalesce("_to", key)).drop("_to")

    links, labels, turn = links_of(edges, a, b), None, 0
    n = most = links.count()
    while n or labels is None:
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("d")), F.struct(F.col("v").alias("s"), F.col("u").alias("d")))).alias("e")).select("e.*")
        order = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), F.col(c).alias("k"))
        low = ends.groupBy("s").agg(F.min(order("d")).alias("low"))
        step = ws.save(low.select(F.col("s").alias("vertex"), F.least(order("s"), F.col("low"))["k"].alias("label")))
        while True:
            jumped = ws.save(renamed(step.withColumn("_before", F.col("label")), step, "label", 2 * n).select("vertex", "label", (F.col("label") != F.col("_before")).alias("moved")))
            step = jumped.select("vertex", "label")
            if not jumped.where("moved").limit(1).count():
                break
        labels = step if labels is None else ws.save(renamed(labels, step, "label", 2 * most).select("vertex", "label"))
        links, turn = links_of(renamed(renamed(links, step, "u", n), step, "v", n), "u", "v"), turn + 1
        n = links.count()
    smallest = labels.groupBy("label").agg(F.min("vertex").alias("low"))
    return split_join(labels, smallest, "label", heavy(labels, "label", 2 * most)).select("vertex", F.col("low").alias("label"))


def validation_families(rows: DataFrame, pairs: DataFrame, row_id: str = "row_id", key: str = "pair_id") -> DataFrame:
    """(row_id, cv_group): rows with the same pair id, or linked by a near-duplicate pair (i, j), directly or by way of others.

    Groups are numbered ``cv_k`` by hash-free names: the smallest row id of the group. Pairs whose ids the rows lack are ignored.
    """
    ids = rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.when(~strip(F.col(key)).isin("", "nan"), F.col(key)).alias("k"))
    lows = ids.where("k is not null").groupBy("k").agg(F.min("row_id").alias("i"), F.count("*").alias("n")).where("n > 1")
    stars = split_join(ids.where("k is not null"), lows, "k", heavy_keys(ids, "k")).where("i <> row_id").select("i", F.col("row_id").alias("j"))
    known = ids.select("row_id")
    near = pairs.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).join(known.withColumnRenamed("row_id", "i"), "i", "left_semi").join(known.withColumnRenamed("row_id", "j"), "j", "left_semi")
    labels = connected(stars.union(near.select("i", "j")), "i", "j").withColumnRenamed("vertex", "row_id")
    return ids.select("row_id").join(labels, "row_id", "left").select("row_id", F.concat(F.lit("cv_"), F.coalesce("label", "row_id").cast("string")).alias("cv_group"))


def topic_components(rows: DataFrame, family: str = "cv_group", topic: str = "topic") -> DataFrame:
    """(topic, component, families, crossing): topics that share a family, directly or by way of others.

    ``crossing`` counts the component's families with more than one topic. Only distinct (family, topic) pairs are joined.
    """
    pairs = Workspace(rows.sparkSession).save(rows.where(F.col(family).isNotNull() & F.col(topic).isNotNull()).select(F.col(family).alias("f"), F.col(topic).cast("bigint").alias("t")).distinct())
    low = pairs.groupBy("f").agg(F.min("t").alias("a"), F.count("*").alias("n"))
    links = pairs.join(low.where("n > 1"), "f").where("a <> t").select("a", F.col("t").alias("b")).distinct()
    labels = connected(links, "a", "b")
    named = pairs.join(F.broadcast(labels), pairs["t"] == labels["vertex"], "left").withColumn("component", F.coalesce("label", "t"))
    sizes = named.groupBy("component").agg(F.count_distinct("f").alias("families"))
    across = low.where("n > 1").join(F.broadcast(named.select(F.col("t").alias("a"), "component").distinct()), "a").groupBy("component").agg(F.count("*").alias("crossing"))
    return named.select(F.col("t").alias("topic"), "component").distinct().join(sizes, "component").join(across, "component", "left").select("topic", "component", "families", F.coalesce("crossing", F.lit(0)).alias("crossing"))


def split_families(rows: DataFrame, key: str = "pair_id", group: str = "cv_group") -> DataFrame:
    """(key, groups): keys whose rows are in more than one group; an intact table has none."""
    return rows.where(F.col(key).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count_distinct(group).alias("groups")).where("groups > 1")


def broken_links(rows: DataFrame, pairs: DataFrame, row_id: str = "row_id", group: str = "cv_group") -> DataFrame:
    """(i, j) pairs whose two rows are in different groups."""
    g = rows.select(F.col(row_id).alias("r"), F.col(group).alias("g")).where("g is not null")
    p = pairs.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).distinct()
    return p.join(g.withColumnsRenamed({"r": "i", "g": "gi"}), "i").join(g.withColumnsRenamed({"r": "j", "g": "gj"}), "j").where("gi <> gj").select("i", "j")


def group_column(rows: DataFrame, columns: Sequence[str] = ("cv_group", "pair_id")) -> str:
    """The first of the columns that the table has and that is complete; an error if there is none."""
    here = [c for c in columns if c in rows.columns]
    if here:
        missing = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in here]).first()
        for c in here:
            if not missing[c]:
                return c
    raise ValueError(f"no complete grouping column among {list(columns)}")

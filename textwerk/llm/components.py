"""Groups of records that are linked directly or by way of others.

Two methods over the same input, an edge table of two bigint columns:

* :func:`peeled_components` removes the giant component by breadth-first joins from the vertex of highest
  degree, then labels what is left by minimum propagation.
* :func:`seeded_components` expands many seeds at once over hash-partitioned adjacency and merges the seeds
  whose areas touch in the much smaller graph of seeds.

Both label a vertex with the smallest id of its component. Vertices without an edge do not occur in the result.
Null ends and loops are no links; repeated links, in either direction, count once. An empty table gives an empty one.

One vertex may have most of the links, and one label most of the vertices. Such keys are counted exactly, and their rows meet a broadcast
of the few rows of the other side instead of being shuffled to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwerk.operators.durable import Workspace
from textwerk.operators.skew import LEAST_ROWS, heavy_keys, split_join

#: Rounds of breadth-first search after which the rest of a long component is left to minimum propagation.
BFS_ROUNDS = 24
#: Partitions over which the links of a heavy vertex are spread.
SALTS = 64


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links (u < v) without nulls and loops."""
    a_, b_ = F.col(f"`{a}`").cast("bigint"), F.col(f"`{b}`").cast("bigint")
    return edges.where(a_.isNotNull() & b_.isNotNull() & (a_ != b_)).select(F.least(a_, b_).alias("u"), F.greatest(a_, b_).alias("v")).distinct()


def both_ways(links: DataFrame) -> DataFrame:
    """Each link from either end."""
    return links.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.*")


def _heavy(rows: DataFrame, key: str, n: int) -> list[int]:
    """The heavy keys of at most ``n`` rows; nothing is counted where a key cannot be heavy."""
    return heavy_keys(rows, key) if n >= LEAST_ROWS else []


def hubs(links: DataFrame, n: int) -> list[int]:
    """The vertices with very many of the ``n`` links."""
    return _heavy(both_ways(links), "src", n)


def order(vertex: Column, turn: int) -> Column:
    """A pseudo-random total order of the vertices, another one in each turn."""
    return F.struct(F.xxhash64(vertex, F.lit(turn)).alias("h"), vertex.alias("vertex"))


def contracted(ws: Workspace, links: DataFrame, labels: DataFrame, heavy: list[int]) -> DataFrame:
    """The links between the labels of their ends; an end without a label keeps its id."""
    for end in ("u", "v"):
        of = labels.select(F.col("vertex").alias(end), F.col("label").alias("l" + end))
        links = split_join(links, of, end, heavy, "left").withColumn("l" + end, F.coalesce("l" + end, end))
    return ws.save(undirected(links, "lu", "lv"))


def _heavy_labels(pointers: DataFrame, n: int) -> tuple[list[int], bool]:
    """Labels of very many of at most ``n`` vertices, and whether the last jump moved a pointer; both from one aggregate."""
    if n < LEAST_ROWS:
        return [], bool(pointers.where("moved").limit(1).count())
    most, moved = pointers.groupBy("label").agg(F.count("*").alias("n"), F.max("moved").alias("moved")).agg(F.max("n"), F.max("moved")).first()
    return heavy_keys(pointers, "label") if (most or 0) >= LEAST_ROWS else [], bool(moved)


def _jump(pointers: DataFrame, heavy: list[int]) -> DataFrame:
    """Each vertex points where its target pointed."""
    target = pointers.select(F.col("vertex").alias("label"), F.col("label").alias("to"))
    return split_join(pointers.select("vertex", "label"), target, "label", heavy, "left").select("vertex", F.coalesce("to", "label").alias("label"), F.coalesce(F.col("to") != F.col("label"), F.lit(False)).alias("moved"))


def minimum_labels(ws: Workspace, links: DataFrame) -> DataFrame:
    """(vertex, label) by minimum propagation with contraction.

    In each round a vertex takes the minimum of itself and its neighbours in a pseudo-random order; chains of such pointers are followed to
    their end by doubling, and the links are contracted to those ends. An end is the minimum of its neighbours, which a vertex with a neighbour
    is with a chance of one half at most, so that half of the vertices are expected to go in a round, whatever the shape of
    the component. The smallest id of each end's vertices is its label.
    """
    labels, turn, n = None, 0, links.count()
    most = 2 * n
    while True:
        low = both_ways(links).groupBy(F.col("src").alias("vertex")).agg(F.min(order(F.col("dst"), turn)).alias("low"))
        step = ws.save(low.select("vertex", F.least(order(F.col("vertex"), turn), F.col("low"))["vertex"].alias("label"), F.lit(True).alias("moved")))
        while True:
            heavy, moved = _heavy_labels(step, 2 * n)
            if not moved:
                break
            step, before = ws.save(_jump(step, heavy)), step
            ws.drop(before)
        if labels is None:
            labels = step.select("vertex", "label")
        else:
            to = step.select(F.col("vertex").alias("label"), F.col("label").alias("to"))
            labels = ws.save(split_join(labels, to, "label", _heavy(labels, "label", most), "left").select("vertex", F.coalesce("to", "label").alias("label")))
        links, turn = contracted(ws, links, step, hubs(links, n)), turn + 1
        n = links.count()
        if not n:
            return lowest(labels, most)


def lowest(labels: DataFrame, n: int) -> DataFrame:
    """(vertex, label) with the smallest vertex of each label; there are at most ``n`` vertices."""
    low = labels.groupBy("label").agg(F.min("vertex").alias("low"))
    return split_join(labels, low, "label", _heavy(labels, "label", n)).select("vertex", F.col("low").alias("label"))


def peeled_components(edges: DataFrame, a: str = "i", b: str = "j", bfs_rounds: int = BFS_ROUNDS) -> DataFrame:
    """(vertex, label): the giant component by breadth-first joins, the others by minimum propagation.

    The search begins at the vertex of highest degree (the smallest id among equals) and visits a frontier a
    round: the frontier's links are found by a join, visited vertices are anti-joined away. If ``bfs_rounds`` do
    not exhaust the component, its visited part is contracted to one vertex and minimum propagation does the rest,
    so that the result is the same for a component of any diameter. Extra columns are ignored.
    """
    ws = Workspace(edges.sparkSession)
    links = ws.save(undirected(edges, a, b))
    adjacency = both_ways(links)
    top = adjacency.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).collect()
    if not top:
        return edges.sparkSession.createDataFrame([], "vertex bigint, label bigint")
    heavy = hubs(links, top[0]["count"])
    frontier = ws.save(edges.sparkSession.range(1).select(F.lit(top[0]["src"]).cast("bigint").alias("vertex")))
    visited = [frontier]
    complete = False
    for _ in range(bfs_rounds):
        seen = visited[0]
        for more in visited[1:]:
            seen = seen.union(more)
        reached = split_join(adjacency, frontier.select(F.col("vertex").alias("src")), "src", heavy, "left_semi").select(F.col("dst").alias("vertex")).distinct()
        frontier = ws.save(reached.join(seen, "vertex", "left_anti"))
        if not frontier.limit(1).count():
            complete = True
            break
        visited.append(frontier)
    giant = visited[0]
    for more in visited[1:]:
        giant = giant.union(more)
    giant = ws.save(giant)
    low = giant.agg(F.min("vertex")).first()[0]
    giant_labels = giant.select("vertex", F.lit(low).cast("bigint").alias("label"))
    if complete:
        rest = ws.save(split_join(links, giant.select(F.col("vertex").alias("u")), "u", heavy, "left_anti"))
    else:
        rest = contracted(ws, links, giant_labels, heavy)
    if not rest.limit(1).count():
        return giant_labels
    others = minimum_labels(ws, rest)
    if complete:
        return giant_labels.union(others)
    top = others.where(F.col("vertex") == low).select(F.col("label").alias("top")).first()
    top = low if top is None else top[0]
    return giant_labels.select("vertex", F.lit(top).cast("bigint").alias("label")).union(others.where(F.col("vertex") != low))


def seeded_components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(vertex, label) from many breadth-first searches that run at once.

    Seeds are the vertices whose hash is below that of all neighbours, so that every component has one. In a round
    each frontier vertex hands its seed to its unlabelled neighbours (the smallest seed wins); adjacency rows are
    hash-partitioned by vertex, those of a heavy vertex over ``SALTS`` partitions. Links between the areas of two seeds form a graph of seeds; as a vertex
    with a neighbour is a seed with a chance of one half at most, it is expected to have at most half as many vertices. It is solved
    in the same way, in another pseudo-random order. Extra columns are ignored.
    """
    ws = Workspace(edges.sparkSession)
    links = ws.save(undirected(edges, a, b))
    return lowest(_seeded(ws, links, 0), 2 * links.count())


def _seeded(ws: Workspace, links: DataFrame, turn: int) -> DataFrame:
    """(vertex, label) where a label is some vertex of the component."""
    n = links.count()
    if not n:
        return ws.spark.createDataFrame([], "vertex bigint, label bigint")
    heavy = hubs(links, n)
    salt = F.when(F.col("src").isin(heavy), F.pmod(F.xxhash64("dst"), F.lit(SALTS))).otherwise(F.lit(0)) if heavy else F.lit(0)
    adjacency = ws.save(both_ways(links).repartition("src", salt))
    lows = adjacency.groupBy("src").agg(F.min(order(F.col("dst"), turn)).alias("low")).where(order(F.col("src"), turn) < F.col("low"))
    areas = ws.save(lows.select(F.col("src").alias("vertex"), F.col("src").alias("seed")))
    frontier, parts = areas, [areas]
    while True:
        known = parts[0]
        for more in parts[1:]:
            known = known.union(more)
        reached = split_join(adjacency, frontier.withColumnRenamed("vertex", "src"), "src", heavy).groupBy(F.col("dst").alias("vertex")).agg(F.min("seed").alias("seed"))
        frontier = ws.save(reached.join(known.select("vertex"), "vertex", "left_anti"))
        if not frontier.limit(1).count():
            break
        parts.append(frontier)
        if len(parts) == 8:
            parts = [ws.save(known.union(frontier))]
    seeds = parts[0]
    for more in parts[1:]:
        seeds = seeds.union(more)
    seeds = ws.save(seeds.withColumnRenamed("seed", "label"))
    ws.drop(*parts, adjacency)
    merged = _seeded(ws, contracted(ws, links, seeds, heavy), turn + 1)
    to = merged.select(F.col("vertex").alias("label"), F.col("label").alias("to"))
    return ws.save(split_join(seeds, to, "label", _heavy(seeds, "label", 2 * n), "left").select("vertex", F.coalesce("to", "label").alias("label")))

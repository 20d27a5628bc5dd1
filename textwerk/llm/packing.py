"""Filling containers of fixed capacity with items, by a grouping genetic algorithm on islands.

Items are dealt to shards of bounded size by hash. Each shard is packed on several islands. An individual is an assignment of items to
bins; a child takes whole well-filled bins of one parent over to the other, bins of the other that hold the same items are removed,
and the displaced items go back by best fit, largest first, together with those of its emptiest bins; before that, displaced items replace smaller ones
of a bin that they fill better. Between epochs the best individual of each island moves to the next one by a join. Epochs go on while they save a
container, and a shard rests once it has the fewest that its load allows. Bins that stay far from full are taken apart and packed again across shards.

An item is split only if it alone exceeds the capacity: into full pieces, each with a container of its own, and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textwerk.operators.durable import Workspace

#: Items a shard holds on average, islands a shard, individuals an island, children an epoch, epochs at most.
SHARD_ITEMS, ISLANDS, POPULATION, CHILDREN, EPOCHS = 4000, 2, 4, 10, 8
#: Bins below this share of the capacity are taken apart for the last round.
LOOSE = 0.98
_STATE = "spec_id int, shard int, island int, capacity int, docs binary, pieces binary, sizes binary, population binary, n_bins int, score double"


def best_fit(sizes: np.ndarray, items: np.ndarray, assign: np.ndarray, loads: list[int], capacity: int) -> None:
    """Put ``items``, in the given order, into the fullest bin with room, else into a new one; changes ``assign`` and ``loads``."""
    room = sorted(((capacity - load) << 24) | k for k, load in enumerate(loads) if load < capacity or not load)
    for i, size in zip(items.tolist(), sizes[items].tolist()):
        at = bisect_left(room, size << 24)
        if at < len(room):
            code = room.pop(at)
            k, left = code & 0xFFFFFF, (code >> 24) - size
        else:
            k, left = len(loads), capacity - size
            loads.append(0)
        loads[k] = capacity - left
        assign[i] = k
        insort(room, (left << 24) | k)


def score_of(sizes: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """Number of bins and mean squared filling; the second prefers full bins beside empty ones."""
    loads = np.bincount(assign, weights=sizes)
    return len(loads), float(((loads / capacity) ** 2).mean()) if len(loads) else 1.0


def compact(assign: np.ndarray) -> np.ndarray:
    """The same bins numbered without gaps."""
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def fresh(sizes: np.ndarray, capacity: int, noise: float, r: np.random.Generator) -> np.ndarray:
    """Best fit of the items, largest first by a size that is blurred by ``noise``."""
    assign = np.zeros(len(sizes), np.int32)
    blurred = sizes * (1 + noise * r.standard_normal(len(sizes))) if noise else sizes
    best_fit(sizes, np.argsort(-blurred, kind="stable"), assign, [], capacity)
    return assign


def replaced(sizes: np.ndarray, rest: np.ndarray, assign: np.ndarray, loads: list[int], capacity: int) -> np.ndarray:
    """Let free items take the place of one smaller item of a bin where they leave less room; returns the items that are free then.

    Each bin is tried once, with its smallest item, in the order of its room. Changes ``assign`` and ``loads``.
    """
    if not len(rest) or not loads:
        return rest
    free = sorted((int(sizes[i]), int(i)) for i in rest)
    kept = np.flatnonzero(assign >= 0)
    smallest = {}
    for i in kept[np.argsort(-sizes[kept], kind="stable")].tolist():
        smallest[int(assign[i])] = i
    for k in sorted(smallest, key=lambda k: loads[k] - capacity):
        out = smallest[k]
        room = capacity - loads[k] + int(sizes[out])
        at = bisect_left(free, (room + 1, -1)) - 1
        if at >= 0 and free[at][0] > sizes[out]:
            size, i = free.pop(at)
            loads[k] += size - int(sizes[out])
            assign[i], assign[out] = k, -1
            insort(free, (int(sizes[out]), out))
    return np.array([i for _, i in free], dtype=np.int64)


def child(giver: np.ndarray, taker: np.ndarray, sizes: np.ndarray, capacity: int, r: np.random.Generator) -> np.ndarray:
    """Crossover of two assignments by whole bins."""
    loads = np.bincount(giver, weights=sizes)
    share = loads / capacity
    full = share >= max(0.999, np.quantile(share, 0.5)) if (share >= 0.999).any() else share >= np.quantile(share, 0.7)
    chosen = full & (r.random(len(loads)) < 0.5)
    injected = chosen[giver]
    hit = np.zeros(taker.max() + 1, bool)
    hit[taker[injected]] = True
    own = np.bincount(taker, weights=sizes)
    loose = np.argsort(own + r.random(len(own)))[: max(2, len(own) // 50)]
    hit[loose] = True
    kept = ~injected & ~hit[taker]
    assign = np.full(len(sizes), -1, np.int64)
    assign[kept] = taker[kept]
    assign[injected] = giver[injected] + len(own)
    inside = assign >= 0
    assign[inside] = compact(assign[inside])
    now = np.bincount(assign[inside], weights=sizes[inside]).astype(np.int64).tolist() if inside.any() else []
    assign = assign.astype(np.int32)
    rest = replaced(sizes, np.flatnonzero(~inside), assign, now, capacity)
    best_fit(sizes, rest[np.argsort(-sizes[rest], kind="stable")], assign, now, capacity)
    return compact(assign)


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], r: np.random.Generator) -> list[np.ndarray]:
    """One epoch: children replace the worst individual unless they are worse."""
    rank = lambda a: (lambda s: (s[0], -s[1]))(score_of(sizes, a, capacity))
    ranked = sorted(((rank(a), k, a) for k, a in enumerate(population)), key=lambda x: x[:2])
    bound = -(-int(sizes.sum()) // capacity)
    for c in range(CHILDREN):
        if ranked[0][0][0] <= bound:  # no packing has fewer bins
            break
        x, y = r.choice(len(ranked), 2, replace=False)
        new = child(ranked[min(x, y)][2], ranked[max(x, y)][2], sizes, capacity, r)
        mark = rank(new)
        if mark <= ranked[-1][0]:
            ranked[-1] = (mark, len(population) + c, new)
            ranked.sort(key=lambda x: x[:2])
    return [a for _, _, a in ranked]


def _row(key: tuple, capacity: int, docs: np.ndarray, pieces: np.ndarray, sizes: np.ndarray, population: list[np.ndarray]) -> dict:
    bins, score = score_of(sizes, population[0], capacity)
    return dict(zip(("spec_id", "shard", "island"), key)) | {"capacity": capacity, "docs": docs.tobytes(), "pieces": pieces.tobytes(), "sizes": sizes.tobytes(), "population": np.stack(population).astype(np.int32).tobytes(), "n_bins": bins, "score": score}


def _begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The first epoch of an island: best fit of the items, once exact and then blurred."""
    pdf = pdf.sort_values(["doc_id", "piece"])
    sizes, capacity = pdf["size"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
    r = np.random.default_rng([int(k) & 0xFFFFFFFF for k in key])
    population = [fresh(sizes, capacity, 0.0 if k == 0 and key[2] == 0 else 0.03 * (k + 1), r) for k in range(POPULATION)]
    return pd.DataFrame([_row(tuple(int(k) for k in key), capacity, pdf["doc_id"].to_numpy(np.int64), pdf["piece"].to_numpy(np.int32), sizes, evolve(sizes, capacity, population, r))])


def _go_on(epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for x in pdf.itertuples():
                sizes = np.frombuffer(x.sizes, np.int64)
                population = [*np.frombuffer(x.population, np.int32).reshape(-1, len(sizes))]
                if x.migrant is not None:
                    population[-1] = np.frombuffer(x.migrant, np.int32)
                r = np.random.default_rng([x.spec_id, x.shard, x.island, epoch])
                out.append(_row((x.spec_id, x.shard, x.island), x.capacity, np.frombuffer(x.docs, np.int64), np.frombuffer(x.pieces, np.int32), sizes, evolve(sizes, x.capacity, population, r)))
            if out:
                yield pd.DataFrame(out)

    return run


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for x in pdf.itertuples():
            sizes = np.frombuffer(x.sizes, np.int64)
            assign = np.frombuffer(x.population, np.int32)[: len(sizes)]
            loads = np.bincount(assign, weights=sizes)
            yield pd.DataFrame({"spec_id": x.spec_id, "shard": x.shard, "capacity": x.capacity, "bin": assign, "load": loads[assign].astype(np.int64), "doc_id": np.frombuffer(x.docs, np.int64), "piece": np.frombuffer(x.pieces, np.int32), "size": sizes})


def _packed(ws: Workspace, items: DataFrame) -> DataFrame:
    """(spec_id, shard, capacity, bin, load, doc_id, piece, size) of items (spec_id, capacity, doc_id, piece, size)."""
    counts = items.groupBy("spec_id").agg(F.ceil(F.count("*") / SHARD_ITEMS).alias("shards"))
    dealt = items.join(F.broadcast(counts), "spec_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shards")).cast("int")).drop("shards").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state = ws.save(dealt.groupBy("spec_id", "shard", "island").applyInPandas(_begin, _STATE))
    used = lambda: state.groupBy("spec_id", "shard").agg(F.min("n_bins").alias("n")).agg(F.sum("n")).first()[0]
    bins = used()
    for epoch in range(1, EPOCHS):
        movers = state.select("spec_id", "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), state["population"].substr(F.lit(1), (F.length("sizes") / 2).cast("int")).alias("migrant"))
        after = state.join(movers, ["spec_id", "shard", "island"], "left").mapInPandas(_go_on(epoch), _STATE)
        state, before = ws.save(after), state
        ws.drop(before)
        bins, last = used(), bins
        if bins == last:
            break
    winner = state.groupBy("spec_id", "shard").agg(F.min(F.struct("n_bins", (-F.col("score")).alias("s"), "island")).alias("w")).select("spec_id", "shard", F.col("w.island").alias("island"))
    return ws.save(state.join(winner, ["spec_id", "shard", "island"], "left_semi").mapInPandas(_unpack, "spec_id int, shard int, capacity int, bin int, load bigint, doc_id bigint, piece int, size bigint"))


def pieces_of(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, doc_id, piece, start, size, whole) of documents with ``n_tokens``; whole pieces fill a container alone."""
    cap, n = F.col("capacity"), F.col("n_tokens")
    cut = counts.where("doc_id is not null").crossJoin(F.broadcast(specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("int").alias("capacity"))))
    last = F.greatest(F.ceil(n / cap) - 1, F.lit(0)).cast("int")
    one = cut.select("spec_id", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return one.select("spec_id", "capacity", "doc_id", "piece", (F.col("piece") * cap).alias("start"), F.least(n - F.col("piece") * cap, cap).cast("bigint").alias("size"), (n - F.col("piece") * cap >= cap).alias("whole"))


def packed(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container, place, doc_id, piece, start, size) of every piece of every document, for each of the specs.

    ``counts`` has distinct ``doc_id`` and ``n_tokens`` (null counts as 0); ``place`` counts from 1 within a container and ``start`` is the piece's
    first token in its document. Documents without tokens are pieces of size 0 and take no room. The specs are a small table.
    """
    ws = Workspace(counts.sparkSession)
    sized = ws.save(counts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    pieces = pieces_of(sized, specs)
    items = pieces.where("not whole").select("spec_id", "capacity", "doc_id", "piece", "size")
    first = _packed(ws, items)
    tight = F.col("load") >= LOOSE * F.col("capacity")
    again = _packed(ws, first.where(~tight).select("spec_id", "capacity", "doc_id", "piece", "size"))
    named = first.where(tight).select("*", F.lit("a").alias("turn")).union(again.select("*", F.lit("b").alias("turn")))
    inside = named.select("spec_id", "capacity", F.concat_ws("-", "turn", "shard", "bin").alias("container"), "doc_id", "piece", "size")
    alone = pieces.where("whole").select("spec_id", "capacity", F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("container"), "doc_id", "piece", "size")
    # a container holds at most as many pieces as its shard, so that its list is bounded
    listed = inside.groupBy("spec_id", "capacity", "container").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "doc_id", "piece", "size"))).alias("held"))
    placed = listed.select("spec_id", "capacity", "container", F.posexplode("held").alias("at", "x")).select("spec_id", "container", (F.col("at") + 1).alias("place"), "x.doc_id", "x.piece", (F.col("x.piece") * F.col("capacity")).alias("start"), "x.size")
    return placed.union(alone.select("spec_id", "container", F.lit(1).alias("place"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), "size"))

"""Many penalised multinomial logistic models in the same passes over the rows.

A model is trained on some of the table's units (folds, corpora or both) and predicts others. Each Newton step is one pass in which every
task sums gradients and curvatures of all models over its rows; the sums are added by model. So the number of passes is that of the
steps, not of the models, and what reaches the driver is bounded by models and features, not by rows.

Features are standardised by the training rows; weights carry an L2 penalty of strength 1, intercepts none. Levels are 0 to ``LEVELS - 1``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Levels of the scale.
LEVELS = 6
#: Newton steps at most, and the step below which a model is done.
STEPS, DONE = 25, 1e-6
#: Numeric columns that a feature set may use.
NUMERIC = ("log_tokens", "n_sentences", "tokens_per_sentence", "mean_word_len")
#: Numeric columns, form of the topic (``hot`` is normalised, ``raw`` weighted by its strength) and class weights of each feature set.
SETS: dict[str, tuple[tuple[str, ...], str | None, bool]] = {
    "word_count": (("log_tokens",), None, False),
    "surface": (NUMERIC, None, False),
    "topic": ((), "hot", False),
    "surface_topic": (NUMERIC, "hot", False),
    "topic_balanced": ((), "hot", True),
    "surface_balanced": (NUMERIC, None, True),
    "topic_raw": ((), "raw", False),
    "surface_topic_raw": (NUMERIC, "raw", False),
}
#: Rules that are read off the counts of the training rows: the most frequent level, overall and for each topic (a tree with a leaf a topic).
RULES = ("majority", "topic_tree")


@dataclass(frozen=True)
class Task:
    """One model: its name, feature set, and the units that it learns from and predicts."""

    name: str
    features: str
    train: frozenset[int]
    test: frozenset[int]


def columns_of(features: str, topics: int) -> list[int]:
    """Places of a feature set among all features: numeric columns, topics, weighted topics."""
    numeric, form, _ = SETS[features]
    start = {None: 0, "hot": len(NUMERIC), "raw": len(NUMERIC) + topics}[form]
    return [NUMERIC.index(c) for c in numeric] + ([start + t for t in range(topics)] if form else [])


def matrix(pdf: pd.DataFrame, topics: Sequence[int]) -> np.ndarray:
    """All features of a batch; unknown topics have none."""
    x = np.zeros((len(pdf), len(NUMERIC) + 2 * len(topics)))
    x[:, : len(NUMERIC)] = np.nan_to_num(pdf[list(NUMERIC)].to_numpy(float))
    at = pd.Index(topics).get_indexer(pdf["topic"]) if len(topics) else np.full(len(pdf), -1)
    row = np.flatnonzero(at >= 0)
    x[row, len(NUMERIC) + at[row]] = 1.0
    x[row, len(NUMERIC) + len(topics) + at[row]] = np.nan_to_num(pdf["topic_strength"].to_numpy(float))[row]
    return x


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def curvature(z: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log loss at ``beta`` (levels x features, minus infinity for absent levels)."""
    p = softmax(z @ np.where(np.isfinite(beta), beta, 0.0).T + np.where(np.isfinite(beta[:, 0]), 0.0, -1e9))
    g = ((p - np.eye(len(beta))[y]) * w[:, None]).T @ z
    h = np.zeros((len(beta), z.shape[1], len(beta), z.shape[1]))
    for a in range(len(beta)):
        for b in range(a, len(beta)):
            block = (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
            h[a, :, b], h[b, :, a] = block, block.T
    return g, h.reshape(g.size, g.size)


def step_of(beta: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The next parameters: a penalised Newton step of bounded length; absent levels stay."""
    there = np.isfinite(beta)
    clean = np.where(there, beta, 0.0)
    ridge = np.ones_like(clean)
    ridge[:, 0] = 1e-6
    free = there.ravel()
    move = np.zeros(clean.size)
    a = (h + np.diag(ridge.ravel()))[np.ix_(free, free)]
    move[free] = np.linalg.solve(a, (g + ridge * clean).ravel()[free])
    return np.where(there, clean - np.clip(move.reshape(clean.shape), -4, 4), beta)


def predictions(rows: DataFrame, tasks: Sequence[Task], label: str = "level_rank", unit: str = "unit", row_id: str = "row_id") -> DataFrame:
    """(row_id, name, features, unit, y_true, y_pred) of every row of a task's test units.

    ``rows`` have the ``NUMERIC`` columns, topic, topic_strength, the unit and the label; rows without unit or label are left out. A task without
    training rows predicts nothing. The rows should be a written table, as they are read in every step.
    """
    spark = rows.sparkSession
    held = rows.where(F.col(label).isNotNull() & F.col(unit).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(unit).cast("int").alias("unit"), F.col(label).cast("int").alias("y"), *NUMERIC, F.col("topic").cast("int").alias("topic"), F.col("topic_strength").cast("double").alias("topic_strength"))
    counts = held.groupBy("unit", "topic", "y").agg(F.count("*").alias("n")).toPandas()  # units x topics x levels
    topics = sorted(int(t) for t in counts["topic"].dropna().unique())
    width = len(NUMERIC) + 2 * len(topics)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, of = matrix(pdf, topics), pdf["unit"].to_numpy()
            for u in np.unique(of):
                own = x[of == u]
                yield pd.DataFrame({"unit": [u], "s": [own.sum(0)], "ss": [(own**2).sum(0)]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"unit": [key[0]], "s": [np.sum(list(pdf["s"]), axis=0)], "ss": [np.sum(list(pdf["ss"]), axis=0)]})

    schema = "unit int, s array<double>, ss array<double>"
    moments = {r["unit"]: (np.array(r["s"]), np.array(r["ss"])) for r in held.mapInPandas(sums, schema).groupBy("unit").applyInPandas(add, schema).collect()}
    models, rules = {}, {}
    for k, task in enumerate(tasks):
        own = counts[counts["unit"].isin(task.train)]
        by_level = np.array([own.loc[own["y"] == v, "n"].sum() for v in range(LEVELS)], float)
        n = by_level.sum()
        if not n:
            continue
        if task.features in RULES:
            by_topic = own.pivot_table(index="topic", columns="y", values="n", aggfunc="sum", fill_value=0)
            rules[k] = (int(by_level.argmax()), {int(t): int(r.idxmax()) for t, r in by_topic.iterrows()} if task.features == "topic_tree" else {})
            continue
        at = columns_of(task.features, len(topics))
        s, ss = (sum(moments[u][m] for u in task.train if u in moments)[at] for m in (0, 1))
        mean = s / n
        spread = np.sqrt(np.maximum(ss / n - mean**2, 0))
        beta = np.zeros((LEVELS, len(at) + 1))
        beta[by_level == 0] = -np.inf
        weights = np.divide(n / np.count_nonzero(by_level), by_level, out=np.zeros(LEVELS), where=by_level > 0) if SETS[task.features][2] else np.ones(LEVELS)
        models[k] = {"at": at, "mean": mean, "spread": np.where(spread > 1e-9, spread, 1.0), "beta": beta, "weights": weights, "train": task.train}
    open_ones = set(models)
    for _ in range(STEPS):
        if not open_ones:
            break
        shared = spark.sparkContext.broadcast({k: models[k] for k in sorted(open_ones)})

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[int, list[np.ndarray]] = {}
            for pdf in frames:
                x, of, y = matrix(pdf, topics), pdf["unit"].to_numpy(), pdf["y"].to_numpy()
                for k, m in shared.value.items():
                    mine = np.isin(of, list(m["train"]))
                    if mine.any():
                        z = np.c_[np.ones(mine.sum()), (x[mine][:, m["at"]] - m["mean"]) / m["spread"]]
                        g, h = curvature(z, y[mine], m["weights"][y[mine]], m["beta"])
                        found[k] = [found[k][0] + g, found[k][1] + h] if k in found else [g, h]
            for k, (g, h) in found.items():
                yield pd.DataFrame({"task": [k], "g": [g.ravel()], "h": [h.ravel()]})

        def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"task": [key[0]], "g": [np.sum(list(pdf["g"]), axis=0)], "h": [np.sum(list(pdf["h"]), axis=0)]})

        schema = "task int, g array<double>, h array<double>"
        for r in held.mapInPandas(part, schema).groupBy("task").applyInPandas(total, schema).toPandas().itertuples():
            m = models[r.task]
            g = np.asarray(r.g).reshape(m["beta"].shape)
            new = step_of(m["beta"], g, np.asarray(r.h).reshape(g.size, g.size))
            moved = np.abs(np.where(np.isfinite(new), new - np.where(np.isfinite(m["beta"]), m["beta"], 0), 0)).max()
            m["beta"] = new
            if moved < DONE:
                open_ones.discard(r.task)
    last = spark.sparkContext.broadcast((models, rules))
    listed = list(tasks)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, rules = last.value
        for pdf in frames:
            x, of = matrix(pdf, topics), pdf["unit"].to_numpy()
            for k, task in enumerate(listed):
                mine = np.isin(of, list(task.test))
                if not mine.any() or (k not in models and k not in rules):
                    continue
                if k in rules:
                    usual, by_topic = rules[k]
                    y = pdf["topic"][mine].map(by_topic).fillna(usual).astype(int).to_numpy() if by_topic else np.full(mine.sum(), usual)
                else:
                    m = models[k]
                    z = np.c_[np.ones(mine.sum()), (x[mine][:, m["at"]] - m["mean"]) / m["spread"]]
                    logits = z @ np.where(np.isfinite(m["beta"]), m["beta"], 0.0).T
                    logits[:, ~np.isfinite(m["beta"][:, 0])] = -np.inf
                    y = logits.argmax(1)
                yield pd.DataFrame({"row_id": pdf["row_id"][mine], "name": task.name, "features": task.features, "unit": of[mine], "y_true": pdf["y"][mine], "y_pred": y})

    return held.mapInPandas(place, "row_id bigint, name string, features string, unit int, y_true int, y_pred int")


def of_cells(cells: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The predicted level of each topic, by a model of one-hot topics with counts ``cells`` (topics x levels); the same model as the set ``topic``."""
    n = cells.sum()
    if not n:
        return np.zeros(len(cells), int)
    mean = cells.sum(1) / n
    spread = np.sqrt(np.maximum(mean - mean**2, 0))
    z = np.c_[np.ones(len(cells)), (np.eye(len(cells)) - mean) / np.where(spread > 1e-9, spread, 1.0)]
    topic, level = np.nonzero(cells)
    beta = np.zeros((cells.shape[1], len(cells) + 1))
    beta[cells.sum(0) == 0] = -np.inf
    for _ in range(steps):
        new = step_of(beta, *curvature(z[topic], level, cells[topic, level].astype(float), beta))
        moved = np.abs(np.where(np.isfinite(new), new - np.where(np.isfinite(beta), beta, 0), 0)).max()
        beta = new
        if moved < DONE:
            break
    logits = z @ np.where(np.isfinite(beta), beta, 0.0).T
    logits[:, ~np.isfinite(beta[:, 0])] = -np.inf
    return logits.argmax(1)


def crossed_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """(y_true, y_pred, n) of topics alone under cross-validation, from the number of rows ``n`` by fold, topic and level; what :func:`predictions`
    gives for the set ``topic``, without a pass over the rows."""
    table = cells.groupby(["fold", "topic", "level"])["n"].sum()
    folds, topics = (sorted(cells[c].unique()) for c in ("fold", "topic"))
    t = table.reindex(pd.MultiIndex.from_product([folds, topics, range(LEVELS)]), fill_value=0).to_numpy().reshape(len(folds), len(topics), LEVELS)
    found = np.zeros((LEVELS, LEVELS), np.int64)
    for own in t:
        if (rest := t.sum(0) - own).any():
            for counts, guess in zip(own, of_cells(rest)):
                found[:, guess] += counts
    true, guess = np.nonzero(found)
    return pd.DataFrame({"y_true": true.astype(np.int32), "y_pred": guess.astype(np.int32), "n": found[true, guess]})


def permuted_scores(cells: pd.DataFrame, draws: int, spark, score, seed: int = 42) -> tuple[float, list[float]]:
    """Score of topics alone under cross-validation, and the scores after each of ``draws`` permutations of the labels over all rows.

    ``cells`` has the number of rows by fold, topic and level; a permutation deals the labels to folds and topics of the same sizes, so that it is drawn
    as cells, and each draw has a generator of its own. ``score`` takes a confusion table (true x predicted).
    """
    folds, topics = (sorted(cells[c].unique()) for c in ("fold", "topic"))
    table = np.zeros((len(folds), len(topics), LEVELS), np.int64)
    for r in cells.itertuples():
        table[folds.index(r.fold), topics.index(r.topic), int(r.level)] += r.n

    def scored(t: np.ndarray) -> float:
        confusion = np.zeros((LEVELS, LEVELS))
        for f in range(len(t)):
            guess = of_cells(t.sum(0) - t[f])
            for k, g in enumerate(guess):
                confusion[:, g] += t[f, k]
        return float(score(confusion))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for draw in pdf["id"]:
                r, left = np.random.default_rng([seed, int(draw)]), table.sum((0, 1))
                dealt = np.zeros_like(table)
                for f, k in np.ndindex(*table.shape[:2]):
                    dealt[f, k] = r.multivariate_hypergeometric(left, int(table[f, k].sum()))
                    left = left - dealt[f, k]
                out.append(scored(dealt))
            yield pd.DataFrame({"id": pdf["id"], "score": out})

    found = spark.range(0, draws, 1, min(draws, 64)).mapInPandas(run, "id bigint, score double").orderBy("id").collect()
    return scored(table), [r["score"] for r in found]

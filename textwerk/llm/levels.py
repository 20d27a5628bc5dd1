"""Reading level of texts by a Rasch-style model of word occurrence.

Word w occurs in text d with probability ``sigmoid(o_d + c_w + a_w theta_d + q_w theta_d^2)``: ``theta_d`` is the latent level of the text, ``o_d``
its log length against the usual one. Without the square this is the logistic model with a difficulty ``b_w = -c_w / a_w`` and a discrimination ``a_w`` for
each word, in which every word only grows or only fades as texts get harder; the square lets words have their place in the middle
of the scale (an ideal-point model). Words that do not occur count as much as those that do.

The model is estimated by alternating optimisation over a table of links (text, word):

* words given texts: the number of a word's texts and the sums of their levels and of the squares are sufficient, so that a step is one
  aggregation by word, followed by Newton steps on these sums;
* texts given words: the sums of ``a_w`` and ``q_w`` over a text's words are sufficient, so that a step is a join with the word table and one
  aggregation by text, followed by a look-up in the likelihood on a grid of levels. A label counts as evidence that may be wrong.

It ends when the levels move by less than ``TOLERANCE`` on average. At most ``FIT_ROWS`` labelled texts, chosen by hash, take part in the fit;
every text is then placed by its own words. The scale is tied to the labels by the median place of each label's texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textwerk.llm.families import level_of
from textwerk.llm.prose import common_words, language, least_share, prose_lines
from textwerk.operators.durable import Workspace

#: Fixed value: the scale.
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
#: Labelled texts in the fit, at most, and words of prose that each needs.
FIT_ROWS, FIT_WORDS = 40_000, 20
#: Alternations, at most, and the mean move of a text's level that ends them.
ALTERNATIONS, TOLERANCE = 20, 0.02
#: A word belongs to the model if it is in this share of the fitted texts; there can be at most distinct words a text / share of them.
MODEL_SHARE = 0.003
#: Words of a sentence come together: evidence counts as that of one in so many words.
TEMPER = 3.0
#: Chance that a label is right, that it is next to the right one, and any other label's.
LABEL = (0.85, 0.06, 0.01)
#: Ridge on the slopes and squares of the words.
RIDGE = 1.0
#: Middle of the scale, from which levels are counted in the fit.
CENTRE = 2.5
#: A text disagrees with its label if it has so many words and they are so many levels apart, rounded to whole levels.
LEAST_WORDS, APART = 50, 3
#: Grids of levels and of log lengths.
GRID = np.round(np.arange(-1.5, 6.5001, 0.125), 3)
LENGTHS = np.round(np.arange(-3.0, 3.0001, 0.25), 2)
POWERS = np.stack([np.ones(len(GRID)), GRID - CENTRE, (GRID - CENTRE) ** 2])


@dataclass
class Model:
    """Word parameters by word, likelihood of the absence of all words, prior and scale; picklable and bounded by the model's words."""

    words: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    usual: float = 1.0
    absent: np.ndarray = field(default_factory=lambda: np.zeros((len(LENGTHS), len(GRID))))
    prior: np.ndarray = field(default_factory=lambda: np.zeros(len(GRID)))
    anchors: np.ndarray = field(default_factory=lambda: np.arange(6.0))

    def length_bin(self, n: np.ndarray) -> np.ndarray:
        """Places in ``LENGTHS`` of texts with so many different words."""
        return np.clip(np.rint((np.log(np.maximum(n, 1) / self.usual) - LENGTHS[0]) / 0.25), 0, len(LENGTHS) - 1).astype(int)

    def place(self, raw: np.ndarray, n: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """Posterior mean levels of texts with sums ``raw`` of slopes and squares and ``n`` different words; ``more`` is log evidence on the grid."""
        logs = (raw @ POWERS[1:] + self.absent[self.length_bin(n)]) / TEMPER + self.prior + more
        p = np.exp(logs - logs.max(1, keepdims=True))
        return (p @ GRID) / p.sum(1)

    def reading(self, theta: np.ndarray) -> np.ndarray:
        """Levels on the scale of the labels, 0 to 5."""
        low, high = self.anchors[1] - self.anchors[0], self.anchors[5] - self.anchors[4]
        inside = np.interp(theta, self.anchors, np.arange(6.0))
        return np.clip(inside - np.maximum(0, self.anchors[0] - theta) / low + np.maximum(0, theta - self.anchors[5]) / high, 0, 5)


def words_of(text: str, common: frozenset[str], least: float) -> list[str]:
    """The words of a text's lines of prose."""
    lines, _, _ = prose_lines(text, common, least)
    return [w for line in lines for w in line[2]]


def label_evidence() -> np.ndarray:
    """Log evidence of each label (rows) on the grid: a right label speaks for the levels around it."""
    apart = np.abs(np.subtract.outer(np.arange(6.0), np.clip(GRID, 0, 5)))
    return np.log(np.interp(apart, [0.0, 1.0, 2.0], [LABEL[0], LABEL[1], LABEL[2]]))


def newton(sums: np.ndarray, weights: np.ndarray, steps: int = 25) -> np.ndarray:
    """Parameters (c, a, q) of words with ``sums``: the number of their texts, the sum of their levels and that of the squares, from ``CENTRE``.

    ``weights`` holds the number of texts by length and level. Solves sum(N p x^k) = sums_k, with a ridge on a and q, for each word.
    """
    at = np.argwhere(weights > 0)
    many, offset, x = weights[at[:, 0], at[:, 1]], LENGTHS[at[:, 0]], POWERS[:, at[:, 1]]
    rate = np.clip(sums[:, 0] / many.sum(), 1e-6, 1 - 1e-6)
    b = np.stack([np.log(rate / (1 - rate)), np.zeros(len(sums)), np.zeros(len(sums))], axis=1)
    ridge, products = np.array([1e-6, RIDGE, RIDGE]), (x[:, None] * x[None]).reshape(9, -1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(offset + b @ x, -30, 30)))
        gradient = sums - (many * p) @ x.T - ridge * b
        step = np.linalg.solve(((many * p * (1 - p)) @ products.T).reshape(-1, 3, 3) + np.diag(ridge), gradient[:, :, None])[:, :, 0]
        b = b + np.clip(step, -1, 1)
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return b


def absence(b: np.ndarray) -> np.ndarray:
    """Log chance that no word occurs, by length and level."""
    return np.stack([-np.logaddexp(0, o + b @ POWERS).sum(0) for o in LENGTHS])


def chosen_texts(rows: DataFrame, text: str, row_id: str, level: str, lang: Column | None) -> DataFrame:
    """(lang, text, rank) of all labelled texts, or of about ``FIT_ROWS`` of them by hash if there are more."""
    labelled = rows.select(F.col(f"`{row_id}`").alias("id"), language(lang).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), level_of(F.col(f"`{level}`")).alias("level")).where("text is not null and level is not null")
    n, steps = labelled.count(), 1 << 20
    chosen = labelled.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(steps)) < F.lit(min(steps, int(steps * FIT_ROWS / max(n, 1)) + 1)))
    return chosen.select("lang", "text", (F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")) - 1).cast("int").alias("rank"))


def fit(ws: Workspace, rows: DataFrame, text: str, row_id: str, level: str, prose: tuple[dict, dict], lang: Column | None) -> Model:
    """The model of the labelled texts; one without words if there are none."""
    known = ws.spark.sparkContext.broadcast(prose)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, least = known.value
        for batch in batches:
            found = [sorted(set(w)) if len(w := words_of(t, common.get(g, frozenset()), least.get(g, 0.0))) >= FIT_WORDS else None for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            keep = [k for k, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(keep, pa.int64())), pa.array([found[k] for k in keep], pa.list_(pa.string()))], names=["rank", "words"])

    texts = ws.save(chosen_texts(rows, text, row_id, level, lang).mapInArrow(cut, "rank int, words array<string>").withColumn("text", F.monotonically_increasing_id()))
    held = texts.select("text", "rank", F.size("words").alias("n")).toPandas()  # at most FIT_ROWS rows
    if not len(held):
        return Model()
    counted = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(~F.col("word").rlike(r"^\d+$") & (F.col("n") >= max(3.0, MODEL_SHARE * len(held))))
    words = counted.orderBy("word").toPandas()
    if not len(words):
        return Model()
    ids = ws.spark.createDataFrame(words[["word"]].assign(w=np.arange(len(words), dtype=np.int32)), "word string, w int")
    links = ws.save(texts.select("text", F.explode("words").alias("word")).join(F.broadcast(ids), "word").select("text", "w"))
    held = held.sort_values("text").reset_index(drop=True)
    rank, n = held["rank"].to_numpy(), held["n"].to_numpy()
    model, evidence, theta = Model(usual=float(np.exp(np.log(n).mean()))), label_evidence()[rank], rank.astype(float)
    lengths, place = model.length_bin(n), lambda t: np.clip(np.rint((t - GRID[0]) / 0.125), 0, len(GRID) - 1).astype(int)
    b = raw = None
    for _ in range(ALTERNATIONS):
        # words given texts
        levels = ws.spark.createDataFrame(pd.DataFrame({"text": held["text"], "x": theta - CENTRE}), "text bigint, x double")
        sums = links.join(F.broadcast(levels), "text").groupBy("w").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("t")).toPandas().set_index("w").reindex(range(len(words)), fill_value=0).to_numpy(float)
        weights = np.zeros((len(LENGTHS), len(GRID)))
        np.add.at(weights, (lengths, place(theta)), 1.0)
        b = newton(sums, weights)
        model.absent = absence(b)
        density = weights.sum(0)
        model.prior = np.log(np.convolve(density, np.ones(9) / 9, "same") + 0.01 * density.sum() / len(GRID)) - np.log(density.sum())
        # texts given words
        table = ws.spark.createDataFrame(pd.DataFrame({"w": np.arange(len(words), dtype=np.int32), "a": b[:, 1], "q": b[:, 2]}), "w int, a double, q double")
        raw = links.join(F.broadcast(table), "w").groupBy("text").agg(F.sum("a").alias("a"), F.sum("q").alias("q")).toPandas().set_index("text").reindex(held["text"], fill_value=0.0).to_numpy()
        theta, before = model.place(raw, n, evidence), theta
        if np.abs(theta - before).mean() < TOLERANCE:
            break
    model.words = {w: tuple(map(float, p)) for w, p in zip(words["word"], b)}
    unlabelled = model.place(raw, n)
    middle = np.array([np.median(unlabelled[rank == k]) if (rank == k).any() else np.nan for k in range(6)])
    seen = ~np.isnan(middle)
    middle = np.interp(np.arange(6), np.flatnonzero(seen), middle[seen]) if seen.sum() > 1 else np.arange(6.0)
    model.anchors = np.maximum.accumulate(middle) + 1e-3 * np.arange(6)
    return model


def word_difficulties(model: Model) -> list[tuple[str, float, float]]:
    """(word, difficulty, discrimination) of the model words, on the scale of the labels: the mean level of the texts of usual
    length that a word is found in if all levels were as common, and how much likelier it is there than at the level where it is rarest (in nats)."""
    inside = (GRID >= model.anchors[0]) & (GRID <= max(model.anchors[5], model.anchors[0] + 0.125))
    out = []
    for w, b in sorted(model.words.items()):
        logs = -np.logaddexp(0, -(np.array(b) @ POWERS))[inside]
        p = np.exp(logs - logs.max())
        out.append((w, float(model.reading(np.array([(p * GRID[inside]).sum() / p.sum()]))[0]), float(logs.max() - logs.min())))
    return out


def fitted(rows: DataFrame, text: str = "text", row_id: str = "row_id", level: str = "cefr_level", lang: Column | None = None) -> tuple[Model, tuple[dict, dict]]:
    """The model of the rows, and what tells their lines of prose."""
    common = common_words(rows, text, lang)
    prose = (common, least_share(rows, common, text, lang))
    return fit(Workspace(rows.sparkSession), rows, text, row_id, level, prose, lang), prose


def reading_levels(rows: DataFrame, text: str = "text", row_id: str = "row_id", level: str = "cefr_level", lang: Column | None = None) -> DataFrame:
    """(row_id, n_words, label_rank, reading) of every row with an id; ``reading`` runs from 0 to 5.

    It is null for texts without words of prose, null texts among them, and where there is no model, as no text has a label. A short text is
    placed near the usual level unless its few words say more. The label is only used in the fit. An empty table gives an empty one; equal texts get equal readings.
    """
    model, prose = fitted(rows, text, row_id, level, lang)
    context = rows.sparkSession.sparkContext
    known, shared = context.broadcast(prose), context.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, least = known.value
        model = shared.value
        slope, square = ({w: b[k] for w, b in model.words.items()} for k in (1, 2))
        for batch in batches:
            n, different, raw = [], [], []
            for g, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(t, common.get(g, frozenset()), least.get(g, 0.0)) if t else []
                own = set(words)
                hit = own & slope.keys()
                n.append(len(words)), different.append(len(own)), raw.append((sum(map(slope.__getitem__, hit)), sum(map(square.__getitem__, hit))))
            n = np.array(n, np.int32)
            reading = model.reading(model.place(np.array(raw, float), np.array(different))) if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), batch.column(3), pa.array(reading, pa.float64(), mask=(n == 0) | (not slope))], names=["row_id", "n_words", "label_rank", "reading"])

    rank = (F.array_position(F.array(*map(F.lit, LEVELS)), level_of(F.col(f"`{level}`"))) - 1).cast("int")
    source = rows.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), language(lang).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), rank.alias("label_rank")).where("row_id is not null")
    return source.mapInArrow(place, "row_id bigint, n_words int, label_rank int, reading double")


def disagreeing(levels: DataFrame) -> DataFrame:
    """(row_id) of texts with ``LEAST_WORDS`` or more words that read ``APART`` or more levels below or above their label."""
    return levels.where((F.abs(F.col("reading") - F.col("label_rank")) >= APART - 0.5) & (F.col("n_words") >= LEAST_WORDS)).select("row_id")

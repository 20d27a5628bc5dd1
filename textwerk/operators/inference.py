"""Intervals and tests for tables: exact kernels and resampling.

Everything here works on cells, whose number depends on the categories and not on the data. Resampling rows is drawing cell counts: with
replacement a multinomial, under permutation a table with the same margins, without replacement a multivariate hypergeometric draw. Each
draw has its own generator, seeded by (seed, stratum, draw), so that results do not depend on the partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textwerk.functions.special import chi2_sf, ncx2_interval

#: Draws a task computes at once.
DRAWS = 250
Z = 1.959963984540054


def tables_of(pdf: pd.DataFrame) -> np.ndarray:
    """The table of cells (x, y, n)."""
    return pdf.pivot_table(index="x", columns="y", values="n", aggfunc="sum", fill_value=0).to_numpy(float)


def cramers_v(tables: np.ndarray, corrected: bool = True) -> np.ndarray:
    """V of a stack of tables (draws, rows, columns); empty rows and columns of a draw do not count."""
    t = tables if tables.ndim == 3 else tables[None]
    n = t.sum((1, 2))
    r, c = t.sum(2), t.sum(1)
    with np.errstate(all="ignore"):
        e = r[:, :, None] * c[:, None, :] / n[:, None, None]
        chi2 = np.where(e > 0, (t - e) ** 2 / e, 0.0).sum((1, 2))
        rows, columns = (r > 0).sum(1).astype(float), (c > 0).sum(1).astype(float)
        phi = chi2 / n
        if corrected:
            phi = np.maximum(0, phi - (rows - 1) * (columns - 1) / (n - 1))
            rows, columns = rows - (rows - 1) ** 2 / (n - 1), columns - (columns - 1) ** 2 / (n - 1)
        low = np.minimum(rows, columns) - 1
        out = np.where(low > 0, np.sqrt(phi / low), 0.0)
    return np.where(((r > 0).sum(1) < 2) | ((c > 0).sum(1) < 2), np.nan, out)


def generator(seed: int, stratum: str, draw: int) -> np.random.Generator:
    """The generator of one draw."""
    return np.random.default_rng([seed, zlib.crc32(stratum.encode()), draw])


def resampled(table: np.ndarray, kind: str, size: int, r: np.random.Generator) -> np.ndarray:
    """One draw of a table: ``bootstrap``, ``permutation``, or ``subsample`` of ``size`` rows."""
    counts = table.astype(np.int64)
    if kind == "bootstrap":
        return r.multinomial(int(counts.sum()), (counts / counts.sum()).ravel()).reshape(table.shape)
    if kind == "subsample":
        return r.multivariate_hypergeometric(counts.ravel(), size, method="marginals").reshape(table.shape)
    left, out = counts.sum(0), np.zeros_like(counts)
    for i, n in enumerate(counts.sum(1)[:-1]):
        out[i] = r.multivariate_hypergeometric(left, int(n), method="marginals")
        left = left - out[i]
    out[-1] = left
    return out


def draws(cells: DataFrame, by: str, kind: str, n_draws: int, seed: int = 42, size: int | None = None) -> DataFrame:
    """(by, draw, v): Cramér's V of each draw; ``size`` is that of subsamples. Draws of a stratum are spread over tasks."""
    blocks = -(-n_draws // DRAWS)
    spread = cells.select(F.col(by).cast("string").alias("g"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "n").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table, numbers = tables_of(pdf), np.arange(key[1] * DRAWS, min(n_draws, (key[1] + 1) * DRAWS))
        if size and table.sum() < size:
            return pd.DataFrame({"g": key[0], "draw": numbers, "v": np.nan})
        return pd.DataFrame({"g": key[0], "draw": numbers, "v": cramers_v(np.stack([resampled(table, kind, size or 0, generator(seed, key[0], int(d))) for d in numbers]))})

    return spread.groupBy("g", "block").applyInPandas(run, "g string, draw long, v double").withColumnRenamed("g", by)


def table_tests(cells: DataFrame, by: str) -> DataFrame:
    """(by, n, chi2, dof, p, v, ci_lo, ci_hi): the test of independence and the non-central interval of uncorrected V; 0 to 0 for degenerate tables."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = tables_of(pdf)
        t = t[t.sum(1) > 0][:, t.sum(0) > 0]
        n, low = t.sum(), min(t.shape) - 1
        if low < 1:
            return pd.DataFrame([(key[0], int(n), 0.0, 0, 1.0, 0.0, 0.0, 0.0)], columns=["g", "n", "chi2", "dof", "p", "v", "ci_lo", "ci_hi"])
        e = np.outer(t.sum(1), t.sum(0)) / n
        chi2, dof = float(((t - e) ** 2 / e).sum()), (t.shape[0] - 1) * (t.shape[1] - 1)
        lo, hi = (np.sqrt(x / (n * low)) for x in ncx2_interval(chi2, dof))
        return pd.DataFrame([(key[0], int(n), chi2, dof, chi2_sf(chi2, dof), float(cramers_v(t)[0]), min(1.0, lo), min(1.0, hi))], columns=["g", "n", "chi2", "dof", "p", "v", "ci_lo", "ci_hi"])

    return cells.select(F.col(by).cast("string").alias("g"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "n").groupBy("g").applyInPandas(run, "g string, n long, chi2 double, dof int, p double, v double, ci_lo double, ci_hi double").withColumnRenamed("g", by)


def bootstrap_intervals(cells: DataFrame, by: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """(by, v, bias, sd, and percentile, basic and normal bounds) of bootstrap draws; draws without a V are dropped."""
    v = table_tests(cells, by).select(by, "v")
    d = draws(cells, by, "bootstrap", n_boot, seed).where(~F.isnan("v")).groupBy(by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.percentile("v", 0.025).alias("pct_lo"), F.percentile("v", 0.975).alias("pct_hi"))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return v.join(d, by).select(by, "v", (F.col("mean") - F.col("v")).alias("bias"), "sd", "pct_lo", "pct_hi", F.greatest(F.lit(0.0), 2 * F.col("v") - F.col("pct_hi")).alias("basic_lo"), (2 * F.col("v") - F.col("pct_lo")).alias("basic_hi"), clip(F.col("v") - Z * F.col("sd")).alias("normal_lo"), clip(F.col("v") + Z * F.col("sd")).alias("normal_hi"))


def permutation_test(cells: DataFrame, by: str, n_perm: int = 5000, seed: int = 42) -> DataFrame:
    """(by, v, exceed, p): p is (exceed + 1) / (draws + 1), never 0."""
    v = table_tests(cells, by).select(by, F.col("v").alias("observed"))
    d = draws(cells, by, "permutation", n_perm, seed).join(F.broadcast(v), by)
    return d.groupBy(by).agg(F.first("observed").alias("v"), F.count_if(F.col("v") >= F.col("observed") - 1e-12).alias("exceed"), F.count("*").alias("m")).select(by, "v", "exceed", ((F.col("exceed") + 1) / (F.col("m") + 1)).alias("p"))


def matched_subsamples(cells: DataFrame, by: str, reps: int = 200, seed: int = 42) -> DataFrame:
    """(by, size, mean_v, sd_v, lo, hi) of subsamples of the size of the smallest stratum."""
    size = cells.groupBy(by).agg(F.sum("n").alias("n")).agg(F.min("n")).first()[0] or 0
    d = draws(cells, by, "subsample", reps, seed, int(size)).where(~F.isnan("v"))
    return d.groupBy(by).agg(F.lit(size).alias("size"), F.avg("v").alias("mean_v"), F.stddev_samp("v").alias("sd_v"), F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))


def cmh(terms: DataFrame) -> DataFrame:
    """(level, chi2, df, p, strata, condition) of the general Cochran-Mantel-Haenszel statistic, from the rows of ``mantel_haenszel``.

    Topics absent from every stratum have no row and so no part; singular values below 1e-10 of the largest are cut. Levels with fewer than
    two usable strata are left out.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["level", "chi2", "df", "p", "strata", "condition"]
        topics = sorted(pdf["topic"].unique())[:-1]  # the last follows from the others
        strata = pdf["stratum"].unique()
        if len(strata) < 2 or not topics:
            return pd.DataFrame(columns=columns)
        d, s = np.zeros(len(topics)), np.zeros((len(topics), len(topics)))
        for _, part in pdf.groupby("stratum"):
            part = part.set_index("topic").reindex(topics)
            c = part["n"].fillna(0).to_numpy(float)
            t, m = float(part["total"].max()), float(part["members"].max())
            if np.isnan(t):
                continue
            d += (part["observed"].fillna(0) - part["expected"].fillna(0)).to_numpy(float)
            s += m * (t - m) / (t * t * (t - 1)) * (t * np.diag(c) - np.outer(c, c))
        u, w, vt = np.linalg.svd(s)
        keep = w > 1e-10 * w[0] if w[0] > 0 else np.zeros(len(w), bool)
        stat = float(d @ (vt[keep].T / w[keep]) @ (u[:, keep].T @ d)) if keep.any() else 0.0
        df = int(keep.sum())
        return pd.DataFrame([(str(key[0]), max(0.0, stat), df, chi2_sf(stat, df), len(strata), float(w[0] / w[keep][-1]) if df else None)], columns=columns)

    return terms.groupBy("level").applyInPandas(run, "level string, chi2 double, df int, p double, strata int, condition double")


def adjusted_mutual_information(cells: DataFrame, by: str) -> DataFrame:
    """(by, ami): mutual information adjusted for chance under fixed margins, normalised by the mean entropy."""
    from math import lgamma

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = tables_of(pdf)
        n, a, b = t.sum(), t.sum(1), t.sum(0)
        h = lambda m: -sum(x / n * np.log(x / n) for x in m if x)
        mi = h(a) + h(b) - h(t.ravel())
        lg = np.vectorize(lambda x: lgamma(x + 1))
        emi = 0.0
        for i in a:
            for j in b:
                k = np.arange(max(1, i + j - n), min(i, j) + 1)
                if len(k):
                    p = np.exp(lg(i) + lg(j) + lg(n - i) + lg(n - j) - lg(n) - lg(k) - lg(i - k) - lg(j - k) - lg(n - i - j + k))
                    emi += float((k / n * np.log(n * k / (i * j)) * p).sum())
        base = (h(a) + h(b)) / 2 - emi
        return pd.DataFrame({"g": [key[0]], "ami": [float((mi - emi) / base) if abs(base) > 1e-15 else 1.0]})

    return cells.select(F.col(by).cast("string").alias("g"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "n").groupBy("g").applyInPandas(run, "g string, ami double").withColumnRenamed("g", by)


def interval_coverage(cells: DataFrame, by: str, reps: int = 1000, boot: int = 120, boot_reps: int = 120, seed: int = 42) -> DataFrame:
    """(by, scenario, true_v, reps, ncx2, boot_reps, normal, percentile, basic): share of simulated tables whose intervals hold the true uncorrected V; the bootstrap
    intervals are those of the first ``boot_reps`` tables.

    Scenarios are the observed joint distribution and independence with the same margins.
    """
    blocks, kinds = -(-reps // 20), ("ncx2", "normal", "percentile", "basic")
    spread = cells.select(F.col(by).cast("string").alias("g"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "n").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("scenario", F.explode(F.array(F.lit("observed"), F.lit("independence"))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = tables_of(pdf)
        n = int(t.sum())
        joint = t / n if key[2] == "observed" else np.outer(t.sum(1), t.sum(0)) / n**2
        true = float(np.nan_to_num(cramers_v(joint * n, corrected=False)[0])) if key[2] == "observed" else 0.0
        out = []
        for rep in range(key[1] * 20, min(reps, key[1] * 20 + 20)):
            r = generator(seed, f"{key[0]}/{key[2]}", rep)
            s = r.multinomial(n, joint.ravel()).reshape(t.shape).astype(float)
            s = s[s.sum(1) > 0][:, s.sum(0) > 0]
            low = min(s.shape) - 1
            if low < 1:
                continue
            e = np.outer(s.sum(1), s.sum(0)) / n
            lo, hi = (np.sqrt(x / (n * low)) for x in ncx2_interval(float(((s - e) ** 2 / e).sum()), (s.shape[0] - 1) * (s.shape[1] - 1)))
            held = [lo <= true <= hi, None, None, None]
            if rep < boot_reps:
                b = cramers_v(np.stack([r.multinomial(n, (s / n).ravel()).reshape(s.shape) for _ in range(boot)]).astype(float))
                (p_lo, p_hi), v, sd = np.nanpercentile(b, [2.5, 97.5]), float(cramers_v(s)[0]), float(np.nanstd(b, ddof=1))
                held[1:] = max(0.0, v - Z * sd) <= true <= min(1.0, v + Z * sd), p_lo <= true <= p_hi, max(0.0, 2 * v - p_hi) <= true <= 2 * v - p_lo
            out.append(held)
        return pd.DataFrame({"g": key[0], "scenario": key[2], "true_v": true} | {c: [None if o[k] is None else float(o[k]) for o in out] for k, c in enumerate(kinds)})

    hits = spread.groupBy("g", "block", "scenario").applyInPandas(run, "g string, scenario string, true_v double, ncx2 double, normal double, percentile double, basic double")
    return hits.groupBy(F.col("g").alias(by), "scenario").agg(F.first("true_v").alias("true_v"), F.count("*").alias("reps"), F.avg("ncx2").alias("ncx2"), F.count("normal").alias("boot_reps"), F.avg("normal").alias("normal"), F.avg("percentile").alias("percentile"), F.avg("basic").alias("basic"))


def detectable_association(cells: DataFrame, by: str, sims: int = 400, power: float = 0.8, seed: int = 42) -> DataFrame:
    """(by, critical_v, size, detectable_v): the smallest simulated strength that is found with the given power.

    A strength tilts each level towards its own topics, by turns; strengths are independent groups, and the smallest is taken afterwards.
    """
    strengths = np.round(np.arange(0.0, 0.89, 0.02), 2)
    spread = cells.select(F.col(by).cast("string").alias("g"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "n").withColumn("strength", F.explode(F.array(*[F.lit(float(s)) for s in strengths])))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = tables_of(pdf)
        n = int(t.sum())
        r = generator(seed, f"{key[0]}/null", 0)
        null = np.outer(t.sum(1), t.sum(0)) / n**2
        critical = np.nanpercentile(np.nan_to_num(cramers_v(np.stack([r.multinomial(n, null.ravel()).reshape(t.shape) for _ in range(sims)]).astype(float))), 95)
        tilt = null * (1 - key[1])
        for i in range(t.shape[0]):
            own = np.arange(t.shape[1]) % t.shape[0] == i
            if own.any():
                tilt[i, own] += key[1] * null[i].sum() * t.sum(0)[own] / max(1.0, t.sum(0)[own].sum())
        r = generator(seed, f"{key[0]}/{key[1]}", 1)
        v = np.nan_to_num(cramers_v(np.stack([r.multinomial(n, (tilt / tilt.sum()).ravel()).reshape(t.shape) for _ in range(sims)]).astype(float)))
        return pd.DataFrame({"g": [key[0]], "strength": [key[1]], "critical_v": [critical], "found": [float((v > critical).mean())], "true_v": [float(np.nan_to_num(cramers_v(tilt * n, corrected=False)[0]))]})

    s = spread.groupBy("g", "strength").applyInPandas(run, "g string, strength double, critical_v double, found double, true_v double")
    return s.groupBy(F.col("g").alias(by)).agg(F.first("critical_v").alias("critical_v"), F.max(F.when(F.col("strength") == 0, F.col("found"))).alias("size"), F.min(F.when((F.col("found") >= power) & (F.col("strength") > 0), F.col("true_v"))).alias("detectable_v"))


def metric_intervals(cells: DataFrame, by: str, metric: Callable[[np.ndarray], float], n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """(by, value, lo, hi) of a metric of the confusion table, by drawing its cells."""
    blocks = -(-n_boot // DRAWS)
    spread = cells.select(F.col(by).cast("string").alias("g"), F.col("y_true").alias("x"), F.col("y_pred").alias("y"), "n").withColumn("block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        levels = sorted({*pdf["x"], *pdf["y"]})
        t = np.zeros((len(levels), len(levels)))
        for x, y, n in zip(pdf["x"], pdf["y"], pdf["n"]):
            t[levels.index(x), levels.index(y)] += n
        if key[1] < 0:
            return pd.DataFrame({"g": [key[0]], "draw": [-1], "value": [metric(t)]})
        numbers = np.arange(key[1] * DRAWS, min(n_boot, (key[1] + 1) * DRAWS))
        return pd.DataFrame({"g": key[0], "draw": numbers, "value": [metric(resampled(t, "bootstrap", 0, generator(seed, key[0], int(d)))) for d in numbers]})

    d = spread.groupBy("g", "block").applyInPandas(run, "g string, draw long, value double")
    return d.groupBy(F.col("g").alias(by)).agg(F.max(F.when(F.col("draw") < 0, F.col("value"))).alias("value"), F.percentile(F.when((F.col("draw") >= 0) & ~F.isnan("value"), F.col("value")), 0.025).alias("lo"), F.percentile(F.when((F.col("draw") >= 0) & ~F.isnan("value"), F.col("value")), 0.975).alias("hi"))


def weighted_f1(t: np.ndarray) -> float:
    """Weighted F1 of a confusion table; nan where fewer than two classes were drawn."""
    s, q, h = t.sum(1), t.sum(0), np.diag(t)
    if (s > 0).sum() < 2:
        return float("nan")
    with np.errstate(all="ignore"):
        f = np.where(s + q > 0, 2 * h / (s + q), 0.0)
    return float((f * s).sum() / s.sum())


def spearman_of(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Rank correlation of cells: values coded from 0 in their order, with counts; nan for a constant."""
    def ranks(codes: np.ndarray) -> np.ndarray:
        m = np.bincount(codes, n)
        return (np.cumsum(m) - m + (m + 1) / 2)[codes]

    a, b = ranks(x), ranks(y)
    a, b = a - np.average(a, weights=n), b - np.average(b, weights=n)
    spread = np.sqrt((n * a * a).sum() * (n * b * b).sum())
    return float((n * a * b).sum() / spread) if spread > 0 else float("nan")


def spearman_intervals(cells: DataFrame, by: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """(by, n, rho, lo, hi): rank correlation of x and y of cells (by, x, y, n), with the percentile interval of bootstrap draws of the cells."""
    blocks = -(-n_boot // DRAWS)
    spread = cells.select(F.col(by).cast("string").alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "n").withColumn("block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        x, y = (np.unique(pdf[c], return_inverse=True)[1] for c in ("x", "y"))
        n = pdf["n"].to_numpy(np.int64)
        if key[1] < 0:
            return pd.DataFrame({"g": [key[0]], "draw": [-1], "n": [n.sum()], "rho": [spearman_of(x, y, n)]})
        numbers = np.arange(key[1] * DRAWS, min(n_boot, (key[1] + 1) * DRAWS))
        drawn = [generator(seed, key[0], int(k)).multinomial(n.sum(), n / n.sum()) for k in numbers]
        return pd.DataFrame({"g": key[0], "draw": numbers, "n": n.sum(), "rho": [spearman_of(x, y, c) for c in drawn]})

    found = spread.groupBy("g", "block").applyInPandas(run, "g string, draw int, n bigint, rho double").where(~F.isnan("rho"))
    boot = F.when(F.col("draw") >= 0, F.col("rho"))
    return found.groupBy(F.col("g").alias(by)).agg(F.max("n").alias("n"), F.max(F.when(F.col("draw") < 0, F.col("rho"))).alias("rho"), F.percentile(boot, 0.025).alias("lo"), F.percentile(boot, 0.975).alias("hi"))


def placebo_bins(binned: DataFrame, by: str, bins: str = "bin", reps: int = 200, seed: int = 42) -> DataFrame:
    """(by, observed, placebo_mean, placebo_hi): mean V within bins against bins of the same sizes dealt at random.

    ``binned`` are cells (by, bin, x, y, n). Dealing rows to bins is drawing their cells without replacement, bin after bin.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys, bs = (sorted(pdf[c].unique()) for c in ("x", "y", "b"))
        t = np.zeros((len(bs), len(xs), len(ys)), np.int64)
        for b, x, y, n in zip(pdf["b"], pdf["x"], pdf["y"], pdf["n"]):
            t[bs.index(b), xs.index(x), ys.index(y)] += n
        observed, out = np.nanmean(cramers_v(t.astype(float))), []
        for rep in range(reps):
            r, left, parts = generator(seed, str(key[0]), rep), t.sum(0).ravel(), []
            for size in t.sum((1, 2))[:-1]:
                parts.append(r.multivariate_hypergeometric(left, int(size), method="marginals"))
                left = left - parts[-1]
            out.append(np.nanmean(cramers_v(np.stack([*parts, left]).reshape(t.shape).astype(float))))
        return pd.DataFrame({"g": [key[0]], "observed": [float(observed)], "placebo_mean": [float(np.mean(out))], "placebo_hi": [float(np.percentile(out, 97.5))]})

    return binned.select(F.col(by).cast("string").alias("g"), F.col(bins).alias("b"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "n").groupBy("g").applyInPandas(run, "g string, observed double, placebo_mean double, placebo_hi double").withColumnRenamed("g", by)

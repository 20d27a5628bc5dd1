"""Operators against closed forms, brute force and edge cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwerk.functions import special, text as T
from textwerk.operators import association as A, clean as C, folds, graph, inference as I, metrics as M, ranks as R, similarity as S, topics as P


def test_levels(spark):
    raw = ["a1", "A1+", " A1 ", "B2", "c1", "A", "", None, "X9", "B1 +", "B1.12", "PRE-A1"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(C.normalize_level(F.col("x"))).collect()]
    assert got == ["A1", "A1", "A1", "B2", "C1", None, None, None, None, "B1", "B1", None]


@pytest.mark.parametrize("text", ["", "  a b  c ", "one two three. Four!  Five?", "\t\n", "x" * 50_000, "Äpfel sind gut."])
def test_text_functions(spark, text):
    t = F.col("t")
    r = spark.createDataFrame([(text,)], "t string").select(T.word_count(t).alias("n"), T.strip(t).alias("s"), T.mean_length(T.tokens(t)).alias("m"), T.sentence_marks(t).alias("k")).first()
    assert r["n"] == len(text.split()) and r["s"] == text.strip()
    assert r["m"] == pytest.approx(np.mean([len(w) for w in text.split()]) if text.split() else 0)
    assert r["k"] >= 1


def test_char_ngrams(spark):
    got = spark.createDataFrame([("ab Cde",)], "t string").select(T.char_ngrams(F.col("t"))).first()[0]
    assert Counter(got) == Counter([" ab", "ab ", " ab ", " cd", "cde", "de ", " cde", "cde ", " cde "])


def test_weights(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1.0],), ([0.0, 0.0, 0.0],)], "w array<double>")
    assert [r[0] for r in df.select(T.l1_normalised(F.col("w"))).collect()] == [[0.25, 0.5, 0.25], [0.0, 0.0, 0.0]]
    with pytest.raises(Exception, match="weights"):
        spark.createDataFrame([([1.0, -0.1],)], "w array<double>").select(T.l1_normalised(F.col("w"))).collect()


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, text string, dataset string, cefr_level string, pair_id string")


def test_cleaning(spark):
    long = " ".join(f"w{i}" for i in range(12))
    rows = rows_of(spark, [(1, long, "a", "A1", None), (2, f" {long} ", "a", "A1+", " "), (3, long + " x", "a", "A2", "nan"), (4, long + " x", "b", "A2", "p"), (5, "short", "a", "A1", None), (6, None, "a", "A1", None), (7, long + " y", "a", None, None), (8, long + " z", "a", "B1", "k")])
    assert {(r.row_id, r.pair_id) for r in C.clean_texts(rows).collect()} == {(1, "a__1"), (8, "k")}
    audit = {(r.n_rows, r.datasets, r.levels, r.action) for r in C.duplicate_audit(rows).collect()}
    assert audit == {(2, "a", "A1", "keep_first_redundant_copy"), (2, "a|b", "A2", "exclude_all_conflicting_rows")}
    assert C.stage_counts(rows).first().asDict() == {"n_start": 8, "n_sublevel": 1, "n_unusable": 2, "n_short": 1, "n_conflicting": 2, "n_redundant": 1, "n_kept": 2}
    empty = rows.limit(0)
    assert C.clean_texts(empty).count() == 0 and C.duplicate_audit(empty).count() == 0


def cells(spark, table, stratum="s"):
    return spark.createDataFrame([(stratum, f"x{i}", f"y{j}", int(n)) for i, row in enumerate(table) for j, n in enumerate(row) if n], "g string, x string, y string, n bigint")


def test_association_anchors(spark):
    perfect = A.chi_square(cells(spark, np.diag([100, 100, 100]))).first()
    assert perfect["v"] == pytest.approx(1, abs=1e-2)
    phi = A.chi_square(cells(spark, [[40, 10], [10, 40]])).first()
    assert phi["v_uncorrected"] == pytest.approx(0.6) and phi["v"] <= phi["v_uncorrected"] and phi["chi2"] == pytest.approx(36)
    same = A.information(cells(spark, np.diag([10, 20, 30]))).first()
    assert same["u_x_given_y"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)
    planted = A.residuals(A.grid(cells(spark, [[200, 20], [20, 200]]))).agg(F.max("std_residual")).first()[0]
    assert planted > 5
    assert A.chi_square(cells(spark, [[5, 3]])).first()["v"] is None


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert special.chi2_sf(0, 3) == 1 and special.chi2_sf(500, 3) < 1e-100
    assert special.ncx2_cdf(10, 4, 0) == pytest.approx(1 - special.chi2_sf(10, 4))
    draws = np.random.default_rng(1).noncentral_chisquare(6, 30, 200_000)
    assert special.ncx2_cdf(40, 6, 30) == pytest.approx((draws <= 40).mean(), abs=0.004)
    lo, hi = special.ncx2_interval(60, 6)
    assert special.ncx2_cdf(60, 6, lo) == pytest.approx(0.975) and special.ncx2_cdf(60, 6, hi) == pytest.approx(0.025)
    assert special.correlation_p(0.5, 20) == pytest.approx(0.0248, abs=1e-3)
    assert special.signed_rank_p([1, 2, 3, 4, 5]) == pytest.approx(2 / 32)
    cost = np.array([[4, 1, 3], [2, 0, 5], [3, 2, 2]], float)
    assert sum(cost[i, j] for i, j in special.assignment(cost)) == 5


def test_intervals_and_permutations(spark):
    c = cells(spark, [[60, 10, 30], [20, 40, 40]]).union(cells(spark, [[45, 42, 47], [44, 48, 44]], "null"))
    t = {r.g: r for r in I.table_tests(c, "g").collect()}
    assert t["s"].ci_lo <= A.chi_square(c.where("g = 's'")).first()["v_uncorrected"] <= t["s"].ci_hi
    assert t["null"].ci_lo == 0 and t["null"].p > 0.5
    p = {r.g: r.p for r in I.permutation_test(c, "g", 400).collect()}
    assert 0 < p["s"] < 0.01 and p["null"] > 0.1


def test_draws_do_not_depend_on_partitions(spark):
    c = cells(spark, [[6, 1, 3], [2, 4, 4]])
    a = I.draws(c, "g", "bootstrap", 300).orderBy("draw").collect()
    b = I.draws(c.repartition(7), "g", "bootstrap", 300).orderBy("draw").collect()
    assert a == b


def test_cmh_two_by_two_by_k(spark):
    """Equals the classic Mantel-Haenszel statistic without continuity correction."""
    tables = [[[12, 5], [6, 14]], [[9, 7], [4, 11]], [[20, 10], [10, 15]]]
    rows = [(f"s{k}", f"l{i}", f"t{j}") for k, t in enumerate(tables) for i in range(2) for j in range(2) for _ in range(t[i][j])]
    df = spark.createDataFrame(rows, "dataset string, cefr_level string, topic string")
    got = {r.level: r for r in I.cmh(A.mantel_haenszel(df, "cefr_level", "topic", "dataset")).collect()}["l0"]
    d = v = 0.0
    for t in map(np.array, tables):
        n, r, c = t.sum(), t.sum(1), t.sum(0)
        d += t[0, 0] - r[0] * c[0] / n
        v += r[0] * r[1] * c[0] * c[1] / (n * n * (n - 1))
    assert got.chi2 == pytest.approx(d * d / v, rel=1e-9) and got.df == 1


@pytest.mark.parametrize("values", [list(range(100)), [10] * 40 + [20] * 40, [42] * 12, []])
def test_quantile_bins(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    bins = sorted({r["bin"] for r in R.quantile_bins(df, "v").collect()})
    assert len(bins) == {100: 4, 80: 2, 12: 1, 0: 0}[len(values)]


def test_spearman_and_holm(spark):
    r = np.random.default_rng(0)
    x, y = r.integers(0, 20, 200), r.integers(0, 6, 200)
    rank = lambda a: np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)] + [(None, 1)], "x int, y int")
    assert R.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert R.spearman(df.limit(1), "x", "y").first()["rho"] is None
    h = R.holm(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")).orderBy("p").collect()
    assert [r["p_holm"] and round(r["p_holm"], 6) for r in h] == [None, 0.03, 0.06, 0.06]


def test_kappa_uses_present_levels(spark):
    pairs = [(0, 0)] * 5 + [(4, 4)] * 5 + [(0, 4)] * 2 + [(4, 0)]
    a = M.summary(M.confusion(spark.createDataFrame(pairs, "y_true int, y_pred int"))).first()
    b = M.summary(M.confusion(spark.createDataFrame([(x // 4, y // 4) for x, y in pairs], "y_true int, y_pred int"))).first()
    assert a["qwk"] == pytest.approx(b["qwk"]) and a["adjacent_accuracy"] < b["adjacent_accuracy"]


def test_similarity_join_against_brute_force(spark):
    r = np.random.default_rng(3)
    vocabulary = ["apfel", "birne", "kirsche", "haus", "garten", "wolke", "regen", "sonne", "fluss", "berg", "tal", "see"]
    texts = [" ".join(r.choice(vocabulary, 8)) for _ in range(40)]
    texts += [t + " ende" for t in texts[:10]] + ["", texts[0]]
    w = S.char_weights(spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string"))
    vectors: dict = {}
    for x in w.collect():
        vectors.setdefault(x.id, {})[x.term] = x.w
    want = {(i, j) for i in vectors for j in vectors if i < j and sum(v * vectors[j].get(t, 0) for t, v in vectors[i].items()) >= 0.8}
    got = {(x.i, x.j) for x in S.similar_pairs(w, 0.8).collect()}
    assert got == want and len(want) > 8


def test_families_and_components(spark):
    rows = spark.createDataFrame([(0, "p1"), (1, "p1"), (2, "p2"), (3, "nan"), (4, None)], "row_id bigint, pair_id string")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (3, 99), (None, 1), (2, 2)], "i bigint, j bigint")
    got = {r.row_id: r.cv_group for r in graph.validation_families(rows, pairs).collect()}
    assert got == {0: "cv_0", 1: "cv_0", 2: "cv_0", 3: "cv_3", 4: "cv_3"}
    topics = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3)], "cv_group string, topic int")
    assert {(r.topic, r.component, r.crossing) for r in graph.topic_components(topics).collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}
    assert graph.connected(pairs.limit(0), "i", "j").count() == 0


def test_grouped_folds(spark):
    rows = [(i, f"g{i // 3}", "A1" if i % 2 else "B1") for i in range(600)]
    got = folds.grouped_folds(spark.createDataFrame(rows, "row_id bigint, cv_group string, cefr_level string")).collect()
    assert len(got) == 600 and max(Counter(r.cv_group for r in {(r.cv_group, r.fold): r for r in got}.values()).values()) == 1
    assert max(Counter(r.fold for r in got).values()) <= 1.2 * 120


def test_factorisation_finds_blocks(spark):
    rows = [(i, t, 1.0) for i in range(40) for t in (("a", "b", "c") if i % 2 else ("x", "y", "z"))]
    texts, words = P.factorise(spark.createDataFrame(rows, "id bigint, term string, w double"), 2, 15)
    side = {r.id: int(np.argmax(r.topic_weights)) for r in texts.collect()}
    assert len({side[i] for i in side if i % 2}) == 1 and side[0] != side[1]
    assert {frozenset(r.top_words.split(", ")) for r in P.top_words(words, 3).collect()} == {frozenset("abc"), frozenset("xyz")}


def test_strict_json():
    from textwerk.sources.writers import plain

    assert plain({"a": float("nan"), "b": [math.inf, 1.5]}) == {"a": None, "b": [None, 1.5]}


def test_blanks_are_told_from_others_for_all_characters(spark):
    from textwerk.functions.text import SPACE, tokens, word_count
    from textwerk.operators.clean import enough_tokens

    rows = spark.createDataFrame([(f"{c}a{c}b {c}",) for c in map(chr, range(1, 0x10000)) if not "\ud800" <= c <= "\udfff"] + [(None,), ("",), ("  ",)], "t string")
    t = F.col("t")
    plain = F.filter(F.split(t, rf"[{SPACE}]+"), lambda x: x != "")
    enough = t.rlike(rf"(?:[^{SPACE}]+[{SPACE}]+){{1}}[^{SPACE}]")
    assert not rows.where(~tokens(t).eqNullSafe(plain) | ~word_count(t).eqNullSafe(F.regexp_count(t, F.lit(rf"[^{SPACE}]+"))) | ~enough_tokens(t, 2).eqNullSafe(enough)).count()

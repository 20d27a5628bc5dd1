"""Queries of prediction and resampling do the whole of the job; models are replaced where only the counts matter."""

from inspect import signature

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwerk.operators import inference, logistic, models, topics
from textwerk.plans import learning


@pytest.mark.parametrize("name", ["boosted_trees", "tfidf_prediction"])
def test_every_row_is_predicted_once(spark, data, monkeypatch, name):
    rows = learning.prepared(spark, data)
    monkeypatch.setattr(learning, "prepared", lambda spark, d: rows)
    monkeypatch.setattr(learning, "scored", lambda predictions, *by: predictions)
    monkeypatch.setattr(models, "fit_predict", lambda train, test, features, label: test.withColumn("prediction", F.lit(1.0)))
    got = learning.QUERIES[name](spark, data)
    assert sorted(r.row_id for r in got.select("row_id").collect()) == sorted(r.row_id for r in rows.select("row_id").collect())
    assert {r.fold for r in got.select("fold").distinct().collect()} == set(range(5))


def test_counts_of_resampling(spark, data, monkeypatch):
    draws, seeds = [], []
    rows = learning.prepared(spark, data)
    monkeypatch.setattr(learning, "prepared", lambda spark, d: rows)
    monkeypatch.setattr(learning, "permuted_scores", lambda cells, n, *a: draws.append(n) or (0.5, [0.1] * n))
    monkeypatch.setattr(models, "repeated_benefit", lambda rows, base, more, seeds_=signature(models.repeated_benefit).parameters["seeds"].default, **k: seeds.extend(k.get("seeds", seeds_)) or [0.1] * 5)
    learning.label_permutation(spark, data)
    learning.repeated_benefit(spark, data)
    assert (draws, len(seeds)) == ([200], 5)


def labelled(spark, n=600):
    """Levels that follow length, topics that follow levels, in three corpora and five folds."""
    r = np.random.default_rng(1)
    rows = []
    for i in range(n):
        level = int(r.integers(0, 4))
        rows.append((i, "abc"[i % 3], i % 5, level, float(level + r.normal(0, 0.7)), float(r.normal()), 3.0, float(r.normal()), int((level + (r.random() < 0.3)) % 5), float(r.random())))
    return spark.createDataFrame(rows, "row_id bigint, dataset string, fold int, level_rank int, log_tokens double, n_sentences double, tokens_per_sentence double, mean_word_len double, topic int, topic_strength double")


def brute_fit(x, y, steps=4000):
    """The same objective by plain gradient descent."""
    mean, sd = x.mean(0), x.std(0)
    z = np.c_[np.ones(len(x)), (x - mean) / np.where(sd > 1e-9, sd, 1)]
    b = np.zeros((int(y.max()) + 1, z.shape[1]))
    for _ in range(steps):
        p = logistic.softmax(z @ b.T)
        g = (p - np.eye(len(b))[y]).T @ z
        g[:, 1:] += b[:, 1:]
        b -= 0.5 / len(z) * g
    return lambda v: (np.c_[np.ones(len(v)), (v - mean) / np.where(sd > 1e-9, sd, 1)] @ b.T).argmax(1)


def test_models_of_one_pass_equal_single_fits(spark):
    rows = labelled(spark)
    got = models.cross_predictions(rows, ["majority", "surface", "topic", "topic_tree", "surface_topic_raw"])
    assert got.count() == 5 * 600 and got.groupBy("features").agg(F.count_distinct("row_id").alias("n")).where("n <> 600").count() == 0
    pdf = rows.toPandas()
    by = {(r.features, r.row_id): r.y_pred for r in got.collect()}
    for f in range(5):
        train, test = pdf[pdf["fold"] != f], pdf[pdf["fold"] == f]
        for name, columns in (("surface", list(logistic.NUMERIC)), ("topic", None)):
            one = lambda p: p[columns].to_numpy() if columns else np.eye(5)[p["topic"]]
            want = brute_fit(one(train), train["level_rank"].to_numpy())(one(test))
            assert np.mean(want == [by[name, i] for i in test["row_id"]]) > 0.99
        tree = train.groupby("topic")["level_rank"].agg(lambda v: v.value_counts().sort_index().idxmax())
        assert [by["topic_tree", i] for i in test["row_id"]] == tree[test["topic"]].tolist()


def test_transfer_has_a_diagonal_and_a_floor(spark):
    rows = labelled(spark)
    found = {(r.train, r.test, r.setting): r.n for r in models.transfer_matrix(rows, "surface").groupBy("train", "test", "setting").agg(F.count("*").alias("n")).collect()}
    assert found == {(a, b, "in-corpus" if a == b else "transfer"): 200 for a in "abc" for b in "abc"}
    found = {(r.test, r.setting): r.n for r in models.leave_one_out(rows, "surface").groupBy("test", "setting").agg(F.count("*").alias("n")).collect()}
    assert found == {(a, s): 200 for a in "abc" for s in ("in-corpus", "transfer", "floor")}


def test_permutations_are_of_the_same_sizes(spark):
    pdf = labelled(spark).toPandas()
    cells = pdf.groupby(["fold", "topic", "level_rank"]).size().reset_index(name="n").rename(columns={"level_rank": "level"})
    observed, null = logistic.permuted_scores(cells, 20, spark, inference.weighted_f1)
    assert len(null) == 20 and observed > max(null) and len(set(null)) > 10
    sums = []
    logistic.permuted_scores(cells, 1, spark, lambda c: sums.append(c.sum(1)) or 0.0)
    assert sums[0].tolist() == [(pdf["level_rank"] == v).sum() for v in range(6)]


def test_stress_test_needs_as_many_components_as_folds(spark):
    rows = labelled(spark).withColumn("cv_group", F.concat(F.lit("g"), (F.col("row_id") / 2).cast("int"))).withColumn("cefr_level", F.col("level_rank").cast("string"))
    one = spark.createDataFrame([(t, 0) for t in range(5)], "topic bigint, component bigint")
    assert models.stress_test(rows, one)[0] == "not_estimable"
    status, found = models.stress_test(rows, one.withColumn("component", F.col("topic")))
    assert status == "ok" and {r.cv: r.n for r in found.groupBy("cv").agg(F.count("*").alias("n")).collect()} == {"topic": 600, "random": 600}


def test_coverage_of_all_intervals(spark):
    cells = spark.createDataFrame([("c", x, y, 40 + 60 * (x == y)) for x in "ab" for y in "ab"], "g string, x string, y string, n long")
    counts = {k: p.default for k, p in signature(inference.interval_coverage).parameters.items()}
    assert (counts["reps"], counts["boot_reps"], counts["boot"], signature(inference.detectable_association).parameters["sims"].default) == (1000, 120, 120, 400)
    for r in inference.interval_coverage(cells, "g", reps=25, boot_reps=10).collect():
        assert (r.reps, r.boot_reps) == (25, 10)
        assert all(0 <= r[c] <= 1 for c in ("ncx2", "normal", "percentile", "basic"))


def test_rank_correlation_of_cells():
    r = np.random.default_rng(4)
    x, y = r.integers(0, 30, 500), r.integers(0, 6, 500)
    y = np.where(r.random(500) < 0.5, x // 5, y)
    rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    want = np.corrcoef(rank(x), rank(y))[0, 1]
    cells = {}
    for a, b in zip(x, y):
        cells[a, b] = cells.get((a, b), 0) + 1
    codes = lambda v: np.unique(v, return_inverse=True)[1]
    got = inference.spearman_of(codes([a for a, _ in cells]), codes([b for _, b in cells]), np.array(list(cells.values())))
    assert got == pytest.approx(want)
    assert np.isnan(inference.spearman_of(np.zeros(3, int), np.arange(3), np.ones(3)))


def test_topic_models_share_their_passes(spark, monkeypatch):
    r = np.random.default_rng(5)
    dense = r.random((700, 40)) * (r.random((700, 40)) < 0.2)
    weights = spark.createDataFrame([(int(i), f"t{j:02}", float(dense[i, j])) for i, j in zip(*dense.nonzero())], "id bigint, term string, w double")
    passes, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: passes.append(len(v)) or broadcast(v))
    wanted, rounds = [(3, 1), (5, 1), (3, 2)], 6
    found = topics.factorisations(weights, wanted, rounds)
    assert passes[:rounds] == [3] * rounds
    for (k, seed), (texts, words, error) in zip(wanted, found):
        h = np.random.default_rng(seed).random((k, 40)) + 1e-3
        h /= h.sum(1, keepdims=True)

        def solve(h):
            x = np.full((700, k), 1 / k)
            for _ in range(topics.INNER):
                x = x * (dense @ h.T) / (x @ (h @ h.T) + 1e-12)
            return x

        for _ in range(rounds):
            x = solve(h)
            last = np.linalg.norm(dense - x @ h)
            for _ in range(2):
                h = h * (x.T @ dense) / (x.T @ x @ h + 1e-12)
        assert error == pytest.approx(last)
        assert {(r.topic, r.term): r.weight for r in words.collect()} == pytest.approx({(t, f"t{j:02}"): h[t, j] for t in range(k) for j in range(40)})
        x = solve(h)
        got = {r.id: r.topic_weights for r in texts.collect()}
        assert len(got) == (dense.sum(1) > 0).sum() and all(v == pytest.approx(list(x[i])) for i, v in got.items())


def test_keywords_of_own_words(spark):
    r = np.random.default_rng(6)
    weights = spark.createDataFrame([(i, f"t{j:03}", float(r.random()) + 0.1) for i in range(300) for j in r.choice(90, 40, replace=False)], "id bigint, term string, w double")
    vocabulary = weights.select("term").distinct()
    words = topics.hashed_vectors(vocabulary, 1)
    want = {(x.id, x.term): x.w for x in topics.keyword_weights(weights, vocabulary, topics.text_vectors(weights, words), words, 7).collect()}
    got = topics.own_keywords(*topics.numbered(weights), words, 7)
    assert len(want) == 2100 and {(x.id, x.term): x.w for x in got.collect()} == pytest.approx(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_topics_alone_are_cross_validated_from_cells(spark):
    rows = labelled(spark)
    cells = rows.groupBy("fold", "topic", F.col("level_rank").alias("level")).agg(F.count("*").alias("n")).toPandas()
    want = models.cross_predictions(rows, ["topic"]).groupBy("y_true", "y_pred").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, logistic.crossed_cells(cells).itertuples(index=False))) == sorted(map(tuple, want))


def test_topic_sweep_evaluates_all_models_together(spark, data, monkeypatch):
    calls, once = [], topics.coherence
    monkeypatch.setattr(topics, "coherence", lambda *a, **k: calls.append("coherence") or once(*a, **k))
    monkeypatch.setattr(models, "cross_predictions", lambda *a, **k: pytest.fail("models of topics alone need no pass over the rows"))
    got = learning.topic_sweep(spark, data).orderBy("k").collect()
    assert calls == ["coherence"] and [r.k for r in got] == [5, 8, 10, 12, 15, 20, 25, 30]
    assert [r.k for r in got if r.weighted_f1 is not None] == [10, 15, 20]


def test_coherence_and_diversity_of_several_models(spark):
    words = spark.createDataFrame([(m, t, w, float(x)) for m in (0, 1) for t in (0, 1) for x, w in enumerate("abcdef"[m + 2 * t : m + 2 * t + 3])], "m int, topic int, term string, weight double")
    texts = spark.createDataFrame([(i, w) for i in range(40) for w in {"abcdef"[i % 6], "abcdef"[i * i % 5], "abcdef"[i % 4]}], "id bigint, term string")
    for m in (0, 1):
        own = words.where(F.col("m") == m).drop("m")
        assert sorted(topics.coherence(words, texts, by=["m"]).where(F.col("m") == m).drop("m").collect()) == sorted(topics.coherence(own, texts).collect())
        assert topics.diversity(words, by=["m"]).where(F.col("m") == m).first()["diversity"] == topics.diversity(own).first()["diversity"]


def test_texts_are_cut_into_words_once_for_all_folds(spark, monkeypatch):
    rows = labelled(spark, 100).withColumn("text", F.concat(F.lit("Wort_a Über, x der "), F.col("topic").cast("string")))
    seen = []

    def fitted(train, test, features, label):
        seen.append(train.columns)
        return test.withColumn("prediction", F.when(F.col("words") == F.array(F.lit("wort_a"), F.lit("über"), F.lit("der")), 1.0))

    monkeypatch.setattr(models, "fit_predict", fitted)
    got = models.cross_predictions(rows, ["tfidf"])
    assert got.where("y_pred = 1").count() == 100 and len(seen) == 5
    assert all("words" in columns and "text" not in columns for columns in seen)

"""Feature sets, classifiers and cross-validated prediction of levels, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import CountVectorizer, OneHotEncoder, RegexTokenizer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from textwerk.functions import text as T
from textwerk.functions.special import chi2_sf
from textwerk.operators.durable import Workspace
from textwerk.operators.logistic import NUMERIC, RULES, SETS, Task, predictions


def with_features(rows: DataFrame, text: str = "text") -> DataFrame:
    """Surface features of the text."""
    words = T.tokens(F.col(text))
    n, s = F.size(words), T.sentence_marks(F.col(text))
    return rows.withColumns({"log_tokens": F.log1p(n.cast("double")), "n_sentences": s.cast("double"), "tokens_per_sentence": n / s, "mean_word_len": T.mean_length(words)})


def tree_pipeline(columns: Sequence[str], label: str) -> Pipeline:
    """Boosted trees on the columns, one level against the rest."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), OneVsRest(labelCol=label, classifier=GBTClassifier(maxDepth=4, maxIter=15, seed=42))])


def with_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the ``words`` of the text instead of the text."""
    return RegexTokenizer(inputCol=text, outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False).transform(rows).drop(text)


def text_pipeline(label: str, n_train: int) -> Pipeline:
    """TF-IDF of ``words`` (at most 50,000, in three texts or more) into logistic regression; fitted for each fold."""
    from pyspark.ml.feature import IDF, Normalizer

    return Pipeline(stages=[CountVectorizer(inputCol="words", outputCol="tf", minDF=3.0, vocabSize=50_000), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features"), LogisticRegression(labelCol=label, regParam=1.0 / max(1, n_train), maxIter=100)])


def fit_predict(train: DataFrame, test: DataFrame, features: str, label: str = "level_rank") -> DataFrame:
    """Predictions of ``tfidf``, or of boosted trees for a name that ends in ``_trees``."""
    if features == "tfidf":
        return text_pipeline(label, train.count()).fit(train).transform(test)
    return tree_pipeline(SETS[features.removesuffix("_trees")][0], label).fit(train).transform(test)


def cross_predictions(rows: DataFrame, feature_sets: Sequence[str], fold: str = "fold", label: str = "level_rank", k: int = 5) -> DataFrame:
    """(row_id, features, fold, y_true, y_pred): out-of-fold predictions of all folds; the rows are written once.

    Feature sets of :mod:`textwerk.operators.logistic` are fitted together for all folds; ``tfidf`` and ``_trees`` by pipelines, a fold at a time.
    """
    ws = Workspace(rows.sparkSession)
    columns = [c for c in ("row_id", "dataset", "text", "topic", "topic_strength", label, fold, *NUMERIC) if c in rows.columns and (c != "text" or "tfidf" in feature_sets)]
    chosen = rows.select(*dict.fromkeys(columns))
    held = ws.save(with_words(chosen) if "tfidf" in feature_sets else chosen)  # all folds read the same words
    together = [n for n in feature_sets if n in SETS or n in RULES]
    folds = frozenset(range(k))
    out = predictions(held, [Task(n, n, folds - {f}, frozenset({f})) for n in together for f in range(k)], label, fold).select("row_id", "features", F.col("unit").alias("fold"), "y_true", "y_pred") if together else None
    for name in [n for n in feature_sets if n not in together]:
        for f in range(k):
            train, test = held.where(F.col(fold) != f), held.where(F.col(fold) == f)
            p = fit_predict(train, test, name, label).select("row_id", F.lit(name).alias("features"), F.col(fold).alias("fold"), F.col(label).alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
            out = p if out is None else out.union(p)
    return ws.save(out)


def corpus_units(rows: DataFrame, fold: str = "fold", k: int = 5) -> tuple[DataFrame, dict[str, frozenset[int]]]:
    """The rows with a ``unit`` for each corpus and fold, written, and the units of each corpus; corpora are few."""
    corpora = sorted(r[0] for r in rows.select("dataset").distinct().collect() if r[0] is not None)
    number = F.array_position(F.array(*[F.lit(c) for c in corpora]), F.col("dataset")) - 1 if corpora else F.lit(None)
    held = Workspace(rows.sparkSession).save(rows.withColumn("unit", (number * k + F.col(fold)).cast("int")))
    return held, {c: frozenset(range(n * k, n * k + k)) for n, c in enumerate(corpora)}


def within(corpora: dict[str, frozenset[int]], features: str) -> list[Task]:
    """Cross-validation inside each corpus."""
    return [Task(f"{a}|{a}", features, units - {u}, frozenset({u})) for a, units in corpora.items() for u in sorted(units)]


def transfer_matrix(rows: DataFrame, features: str = "topic", label: str = "level_rank") -> DataFrame:
    """(train, test, setting, y_true, y_pred): a model of each corpus applied to every other (``transfer``), and grouped
    cross-validation inside each (``in-corpus``), by the folds of the rows."""
    held, corpora = corpus_units(rows)
    across = [Task(f"{a}|{b}", features, corpora[a], corpora[b]) for a in corpora for b in corpora if a != b]
    found = predictions(held, within(corpora, features) + across, label)
    pair = F.split("name", r"\|")
    return found.select(pair[0].alias("train"), pair[1].alias("test"), F.when(pair[0] == pair[1], "in-corpus").otherwise("transfer").alias("setting"), "y_true", "y_pred")


def leave_one_out(rows: DataFrame, features: str = "topic", label: str = "level_rank") -> DataFrame:
    """(test, setting, y_true, y_pred): a model of all other corpora applied to each corpus (``transfer``), grouped cross-validation inside it
    (``in-corpus``) and its most frequent level (``floor``)."""
    held, corpora = corpus_units(rows)
    everything = frozenset().union(*corpora.values())
    outside = [Task(f"transfer|{a}", features, everything - units, units) for a, units in corpora.items()]
    floor = [Task(f"floor|{a}", "majority", units, units) for a, units in corpora.items()]
    found = predictions(held, within(corpora, features) + outside + floor, label)
    pair = F.split("name", r"\|")
    return found.select(pair[1].alias("test"), F.when(pair[0] == pair[1], "in-corpus").otherwise(pair[0]).alias("setting"), "y_true", "y_pred")


def likelihood_ratio(rows: DataFrame, label: str = "level_rank", topics: int = 10) -> tuple[str, float, int, float]:
    """(status, statistic, df, p) of adding topics to log length in an unpenalised multinomial model; ``skipped`` with fewer than two levels or
    topics, ``dropped`` where the statistic is not finite or negative."""
    held = Workspace(rows.sparkSession).save(rows.where(f"{label} is not null and topic is not null").select(label, "topic", "log_tokens"))
    seen = held.agg(F.count_distinct(label).alias("l"), F.count_distinct("topic").alias("t"), F.count("*").alias("n")).first()
    if seen["l"] < 2 or seen["t"] < 2:
        return "skipped", 0.0, 0, 1.0
    dense = {r["topic"]: k for k, r in enumerate(held.select("topic").distinct().orderBy("topic").collect())}
    held = held.replace({k: v for k, v in dense.items()}, subset=["topic"]) if any(k != v for k, v in dense.items()) else held

    def loss(columns: Sequence[str]) -> float:
        stages = [OneHotEncoder(inputCols=["topic"], outputCols=["hot"], dropLast=True)] if "topic" in columns else []
        stages += [VectorAssembler(inputCols=["log_tokens"] + (["hot"] if "topic" in columns else []), outputCol="features"), LogisticRegression(labelCol=label, maxIter=500, tol=1e-10, family="multinomial")]
        p = Pipeline(stages=stages).fit(held).transform(held)
        from pyspark.ml.functions import vector_to_array

        chance = F.get(vector_to_array("probability"), F.col(label).cast("int"))
        return p.agg(F.sum(F.log(F.greatest(chance, F.lit(1e-300))))).first()[0]

    stat, df = 2 * (loss(["log_tokens", "topic"]) - loss(["log_tokens"])), (seen["t"] - 1) * (seen["l"] - 1)
    if not stat >= -1e-6 or stat == float("inf"):
        return "dropped", 0.0, df, 1.0
    return "ok", max(0.0, stat), df, chi2_sf(stat, df)


def repeated_benefit(rows: DataFrame, base: str, more: str, seeds: Sequence[int] = (1, 2, 3, 4, 5), group: str = "cv_group", label: str = "level_rank") -> list[float]:
    """Difference in weighted F1 of two feature sets under grouped folds, for each seed."""
    from textwerk.operators.folds import grouped_folds
    from textwerk.operators.metrics import confusion, summary

    out = []
    for seed in seeds:
        folded = grouped_folds(rows.drop("fold"), group, seed=seed)
        scores = {r["features"]: r["weighted_f1"] for r in summary(confusion(cross_predictions(folded, [base, more], label=label), ["features"]), ["features"]).collect()}
        out.append(scores.get(more, 0.0) - scores.get(base, 0.0))
    return out


def stress_test(rows: DataFrame, components: DataFrame, features: Sequence[str] = ("topic",), label: str = "level_rank", group: str = "cv_group", k: int = 5) -> tuple[str, DataFrame | None]:
    """Cross-validation whose folds keep linked topics (topic, component) whole, against random folds that keep groups whole:
    ``not_estimable`` with fewer components than folds, else ``ok`` with (cv, features, y_true, y_pred)."""
    from textwerk.operators.folds import grouped_folds

    joined = rows.drop("fold").join(F.broadcast(components.select("topic", "component")), "topic")
    if components.select("component").distinct().count() < k:
        return "not_estimable", None
    parts = [cross_predictions(folded, features, label=label, k=k).select(F.lit(cv).alias("cv"), "features", "y_true", "y_pred") for cv, folded in (("topic", grouped_folds(joined, "component", None, k)), ("random", grouped_folds(joined, group, k=k)))]
    return "ok", parts[0].union(parts[1])

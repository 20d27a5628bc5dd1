"""Queries of groups, similarity and inference; most have no plain SQL form and are checked by tests."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textwerk.operators import association as A, graph as G, inference as I, metrics as M, ranks as R, similarity as S
from textwerk.operators.durable import Workspace, table
from textwerk.operators.tiles import similar_by_ngrams
from textwerk.plans.corpus import CLEAN, texts_of
from textwerk.plans.named import registrar
from textwerk.plans.stats import length_rule, measured, topical

QUERIES, SQL, query = registrar()


def corpus_cells(spark, d):
    """Cells of level and topic in each corpus."""
    return A.cells_of(topical(spark, d), "cefr_level", "topic", ["dataset"])


@query()
def independence_tests(spark, d):
    return I.table_tests(corpus_cells(spark, d), "dataset")


@query()
def bootstrap_intervals(spark, d):
    return I.bootstrap_intervals(corpus_cells(spark, d), "dataset")


@query()
def permutation_tests(spark, d):
    return R.holm(I.permutation_test(corpus_cells(spark, d), "dataset"))


@query()
def matched_subsamples(spark, d):
    return I.matched_subsamples(corpus_cells(spark, d), "dataset")


@query()
def interval_coverage(spark, d):
    return I.interval_coverage(corpus_cells(spark, d), "dataset")


@query()
def detectable_association(spark, d):
    return I.detectable_association(corpus_cells(spark, d), "dataset")


@query()
def adjusted_information(spark, d):
    return I.adjusted_mutual_information(corpus_cells(spark, d), "dataset")


@query()
def cmh_by_level(spark, d):
    return R.holm(I.cmh(A.mantel_haenszel(topical(spark, d), "cefr_level", "topic", "dataset")))


@query()
def cmh_within_lengths(spark, d):
    binned = R.quantile_bins(measured(spark, d), "word_count", 4).where("topic is not null")
    return R.holm(I.cmh(A.mantel_haenszel(binned, "cefr_level", "topic", "bin")))


@query()
def metric_intervals(spark, d):
    return I.metric_intervals(M.confusion(length_rule(spark, d), ["dataset"]), "dataset", I.weighted_f1)


@query()
def length_level_interval(spark, d):
    """Rank correlation of length and level in each corpus, with its bootstrap interval."""
    return I.spearman_intervals(A.cells_of(measured(spark, d), "word_count", "level_rank", ["dataset"]), "dataset")


@query()
def interval_overlap(spark, d):
    """Whether the intervals of the association of each two corpora overlap; corpora are few."""
    rows = sorted((r["dataset"], r["ci_lo"], r["ci_hi"]) for r in I.table_tests(corpus_cells(spark, d), "dataset").collect())
    pairs = [(a[0], b[0], bool(a[1] <= b[2] and b[1] <= a[2])) for k, a in enumerate(rows) for b in rows[k + 1 :]]
    return spark.createDataFrame(pairs, "a string, b string, overlap boolean")


@query()
def corpus_ranking(spark, d):
    """Corpora by the association of level and topic, as it is and at the size of the smallest one, and the rank correlation of both orders."""
    cells = corpus_cells(spark, d)
    both = I.table_tests(cells, "dataset").select("dataset", "v").join(I.matched_subsamples(cells, "dataset").select("dataset", "mean_v"), "dataset")
    place = lambda c: F.rank().over(Window.orderBy(F.desc(c)))
    ranked = both.withColumns({"place": place("v"), "matched_place": place("mean_v")})
    return ranked.withColumn("rho", F.corr("place", "matched_place").over(Window.partitionBy()))


@query()
def placebo_length_bins(spark, d):
    binned = R.quantile_bins(measured(spark, d), "word_count", 4, ["dataset"])
    return I.placebo_bins(A.cells_of(binned, "cefr_level", "topic", ["dataset", "bin"]), "dataset")


@query()
def length_stratified(spark, d):
    """Association of level and topic within length quartiles of each corpus: size, V, its interval and permutation test, the smallest association that would be
    found, and the rank correlation of length and level that is left. A bin with fewer than two levels or topics keeps its row, without these."""
    binned = R.quantile_bins(measured(spark, d), "word_count", 4, ["dataset"]).withColumn("stratum", F.concat_ws("/", "dataset", "bin"))
    cells = A.cells_of(binned, "cefr_level", "topic", ["stratum"])
    sizes = cells.groupBy("stratum").agg(F.sum("n").alias("size"), F.count_distinct("x").alias("levels"), F.count_distinct("y").alias("topics"))
    usable = A.Workspace(spark).save(cells.join(F.broadcast(sizes.where("levels > 1 and topics > 1").select("stratum")), "stratum"))
    tests = I.table_tests(usable, "stratum").select("stratum", "v", "ci_lo", "ci_hi", "p")
    perm = I.permutation_test(usable, "stratum", 1000).select("stratum", F.col("p").alias("perm_p"))
    power = I.detectable_association(usable, "stratum").select("stratum", "detectable_v")
    left = I.spearman_intervals(A.cells_of(binned, "word_count", "level_rank", ["stratum"]), "stratum", 200).select("stratum", F.col("rho").alias("residual_rho"))
    return sizes.join(tests, "stratum", "left").join(perm, "stratum", "left").join(power, "stratum", "left").join(left, "stratum", "left")


_FAMILIES = """WITH RECURSIVE k AS (SELECT row_id, CASE WHEN regexp_replace(pair_id, '^\\s+|\\s+$', '', 'g') NOT IN ('', 'nan') THEN pair_id END AS pair_id FROM combined_csv),
links AS (SELECT min(row_id) OVER (PARTITION BY pair_id) AS u, row_id AS v FROM k WHERE pair_id IS NOT NULL UNION SELECT i, j::BIGINT FROM near_duplicates_de WHERE similarity >= 0.85 AND i IN (SELECT row_id FROM k) AND j IN (SELECT row_id FROM k)),
two AS (SELECT u AS a, v AS b FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v), walk(a, b) AS (SELECT a, b FROM two UNION SELECT w.a, t.b FROM walk w JOIN two t ON w.b = t.a),
fam AS (SELECT a AS row_id, least(a, min(b)) AS low FROM walk GROUP BY a), g AS (SELECT row_id, 'cv_' || coalesce(low, row_id) AS cv_group FROM k LEFT JOIN fam USING (row_id))"""


def strong_pairs(spark, d):
    """Recorded pairs with a similarity of 0.85 or more."""
    return table(spark, d, "near_duplicates_de").where("similarity >= 0.85")


@query(_FAMILIES + " SELECT row_id, cv_group FROM g")
def validation_families(spark, d):
    return G.validation_families(table(spark, d, "combined_csv"), strong_pairs(spark, d))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT cv_group AS f, topic::BIGINT AS t FROM combined_csv WHERE cv_group IS NOT NULL AND topic IS NOT NULL), two AS (SELECT DISTINCT x.t AS a, y.t AS b FROM p x JOIN p y USING (f)), walk(a, b) AS (SELECT a, b FROM two UNION SELECT w.a, t.b FROM walk w JOIN two t ON w.b = t.a),
c AS (SELECT a AS topic, min(b) AS component FROM walk GROUP BY a) SELECT topic, component, (SELECT count(DISTINCT f) FROM p JOIN c c2 ON c2.topic = p.t WHERE c2.component = c.component) AS families, (SELECT count(*) FROM (SELECT f FROM p JOIN c c3 ON c3.topic = p.t WHERE c3.component = c.component GROUP BY f HAVING count(*) > 1)) AS crossing FROM c""")
def topic_components(spark, d):
    return G.topic_components(table(spark, d, "combined_csv"))


@query("SELECT pair_id AS key, count(DISTINCT cv_group) AS groups FROM combined_csv WHERE pair_id IS NOT NULL AND cv_group IS NOT NULL GROUP BY pair_id HAVING count(DISTINCT cv_group) > 1")
def split_families(spark, d):
    return G.split_families(table(spark, d, "combined_csv"))


@query("SELECT DISTINCT i, j::BIGINT AS j FROM near_duplicates_de n JOIN combined_csv a ON a.row_id = n.i JOIN combined_csv b ON b.row_id = n.j WHERE similarity >= 0.85 AND a.cv_group <> b.cv_group")
def broken_links(spark, d):
    return G.broken_links(table(spark, d, "combined_csv"), strong_pairs(spark, d))


@query()
def similar_texts(spark, d):
    """Pairs of clean texts with a cosine of 0.85 or more over character n-grams, with the attributes of both."""
    texts = Workspace(spark).save(texts_of(spark, d).select("row_id", "text", "dataset", "cefr_level", "pair_id"))
    return S.with_attributes(similar_by_ngrams(texts), texts)


@query(f"""WITH {CLEAN}, w AS (SELECT row_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]+')) AS term FROM texts), c AS (SELECT row_id, term, count(*) AS tf FROM w GROUP BY ALL), s AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 3),
x AS (SELECT row_id, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM texts)) / (1 + df)) + 1) AS w FROM c JOIN s USING (term)) SELECT row_id AS id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight FROM x GROUP BY row_id""")
def word_tfidf(spark, d):
    w = S.word_weights(texts_of(spark, d), max_features=None)
    return w.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("top_weight"))


@query(f"WITH {CLEAN}, t AS (SELECT DISTINCT row_id, unnest(regexp_split_to_array(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+')) AS term FROM texts) SELECT term, count(*) AS df FROM t WHERE term <> '' GROUP BY term HAVING count(*) >= 5")
def document_frequencies(spark, d):
    return S.document_frequencies(texts_of(spark, d)).where("df >= 5")

"""Queries of association, rank and classification statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textwerk.operators import association as A, metrics as M, ranks as R
from textwerk.operators.clean import LEVELS
from textwerk.operators.durable import Workspace, table
from textwerk.operators.metrics import calibration
from textwerk.plans.corpus import CLEAN, texts_of
from textwerk.plans.named import registrar

QUERIES, SQL, query = registrar()


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns rounded to six places, without negative zero."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def measured(spark, d: str) -> DataFrame:
    """The columns of clean texts besides the text, written once, for queries that read them several times."""
    return Workspace(spark).save(texts_of(spark, d).select("row_id", "dataset", "cefr_level", "level_rank", "word_count", "topic"))


def topical(spark, d: str) -> DataFrame:
    """Clean texts that have a topic."""
    return texts_of(spark, d).where("topic is not null")


#: Common table expressions of a contingency table of x and y in strata g, from the table ``z``.
_GRID = """cell AS (SELECT g, x, y, count(*) AS n FROM z WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
gr AS (SELECT a.g, a.x, b.y, coalesce(c.n, 0) AS n, r, c_, t FROM (SELECT g, x, sum(n) AS r FROM cell GROUP BY ALL) a JOIN (SELECT g, y, sum(n) AS c_ FROM cell GROUP BY ALL) b USING (g) JOIN (SELECT g, sum(n) AS t FROM cell GROUP BY ALL) USING (g) LEFT JOIN cell c ON c.g = a.g AND c.x = a.x AND c.y = b.y)"""
_V = """chi AS (SELECT g, max(t)::BIGINT AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k, sum((n - r * c_ / t) ** 2 / (r * c_ / t)) AS chi2 FROM gr GROUP BY g),
cor AS (SELECT *, greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) AS phi, r - (r - 1) ** 2 / (n - 1) AS rc, k - (k - 1) ** 2 / (n - 1) AS kc FROM chi)"""
_VS = "round(chi2, 6) AS chi2, (r - 1) * (k - 1) AS dof, round(CASE WHEN least(r, k) < 2 THEN NULL WHEN least(rc - 1, kc - 1) > 0 THEN sqrt(phi / least(rc - 1, kc - 1)) ELSE 0 END, 6) AS v, round(CASE WHEN least(r - 1, k - 1) > 0 THEN sqrt(chi2 / n / least(r - 1, k - 1)) END, 6) AS v_uncorrected"
_BY = f"WITH {CLEAN}, z AS (SELECT dataset AS g, cefr_level AS x, topic AS y FROM texts), {_GRID}, {_V} "
_ALL = f"WITH {CLEAN}, z AS (SELECT 1 AS g, cefr_level AS x, topic AS y FROM texts), {_GRID}, {_V} "


@query(_BY + f"SELECT g AS dataset, n, r AS rows, k AS columns, {_VS} FROM cor")
def association_by_corpus(spark, d):
    s = A.chi_square(A.cells_of(topical(spark, d), "cefr_level", "topic", ["dataset"]), ["dataset"])
    return rounded(s, "chi2", "v", "v_uncorrected")


@query(_ALL + f"SELECT n, r AS rows, k AS columns, {_VS} FROM cor")
def association_overall(spark, d):
    return rounded(A.chi_square(A.cells_of(topical(spark, d), "cefr_level", "topic")), "chi2", "v", "v_uncorrected")


@query(f"WITH {CLEAN}, z AS (SELECT 1 AS g, dataset AS x, topic AS y FROM texts), {_GRID}, {_V} SELECT n, r AS rows, k AS columns, {_VS} FROM cor")
def association_with_source(spark, d):
    return rounded(A.chi_square(A.cells_of(topical(spark, d), "dataset", "topic")), "chi2", "v", "v_uncorrected")


_ORDERS = "z AS (SELECT r_name AS g, o_orderpriority AS x, c_mktsegment AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def order_cells(spark, d) -> DataFrame:
    """Cells of order priority and market segment in each region; nations and regions are fixed small tables."""
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return A.cells_of(orders, "o_orderpriority", "c_mktsegment", ["r_name"])


@query(f"WITH {_ORDERS}, {_GRID}, {_V} SELECT g AS r_name, n, r AS rows, k AS columns, {_VS} FROM cor")
def association_of_orders(spark, d):
    return rounded(A.chi_square(order_cells(spark, d), ["r_name"]), "chi2", "v", "v_uncorrected")


_INFO = """h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n FROM cell GROUP BY x), (SELECT sum(n) AS t FROM cell)) AS hx, (SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n FROM cell GROUP BY y), (SELECT sum(n) AS t FROM cell)) AS hy, (SELECT -sum(n / t * ln(n / t)) FROM cell, (SELECT sum(n) AS t FROM cell)) AS hxy)"""


@query(_ALL + f", {_INFO} SELECT round(hx, 6) AS h_x, round(hy, 6) AS h_y, round(hx + hy - hxy, 6) AS mi, round((hx + hy - hxy) / hx, 6) AS u_x_given_y, round((hx + hy - hxy) / hy, 6) AS u_y_given_x, round((hx + hy - hxy) / ((hx + hy) / 2), 6) AS nmi FROM h")
def information_measures(spark, d):
    return rounded(A.information(A.cells_of(topical(spark, d), "cefr_level", "topic")), "h_x", "h_y", "mi", "u_x_given_y", "u_y_given_x", "nmi")


_KW = """kv AS (SELECT x, count(*) AS m FROM z WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x), kr AS (SELECT x, m, sum(m) OVER (ORDER BY x) - m + (m + 1) / 2 AS rk FROM kv),
ks AS (SELECT y, count(*) AS k, sum(rk) AS s FROM z JOIN kr USING (x) WHERE y IS NOT NULL GROUP BY y), kn AS (SELECT sum(m)::DOUBLE AS n, 1 - sum(m ** 3 - m) / (sum(m) ** 3 - sum(m)) AS fix FROM kv), kh AS (SELECT count(*) AS groups, sum(s * s / k) AS q FROM ks)"""


@query(f"WITH {CLEAN}, z AS (SELECT level_rank AS x, topic AS y FROM texts), {_KW} SELECT n::BIGINT AS n, groups, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / fix, 6) AS h, round(greatest(0, ((12 / (n * (n + 1)) * q - 3 * (n + 1)) / fix - groups + 1) / (n - groups)), 6) AS epsilon2 FROM kn, kh")
def kruskal_wallis(spark, d):
    return rounded(A.kruskal(A.cells_of(topical(spark, d), "level_rank", "topic")), "h", "epsilon2")


@query(_ALL + ", e AS (SELECT *, r * c_ / t AS e FROM gr) SELECT x AS level, y AS topic, n AS observed, round(e, 6) AS expected, round(n / e, 6) AS obs_over_exp, round(CASE WHEN e * (1 - r / t) * (1 - c_ / t) > 0 THEN (n - e) / sqrt(e * (1 - r / t) * (1 - c_ / t)) ELSE 0 END, 6) + 0.0::DOUBLE AS std_residual FROM e")
def standardised_residuals(spark, d):
    full = A.residuals(A.grid(A.cells_of(topical(spark, d), "cefr_level", "topic")))
    return rounded(full, "expected", "obs_over_exp", "std_residual").select(F.col("x").alias("level"), F.col("y").alias("topic"), F.col("n").alias("observed"), "expected", "obs_over_exp", "std_residual")


@query(_BY + ", e AS (SELECT g, x, y, n, (n - r * c_ / t) / sqrt(r * c_ / t * (1 - r / t) * (1 - c_ / t)) AS z FROM gr WHERE r < t AND c_ < t) SELECT g AS dataset, count_if(abs(z) > 2) AS over_2, count_if(abs(z) > 3) AS over_3 FROM e GROUP BY g")
def strong_cells(spark, d):
    full = A.residuals(A.grid(A.cells_of(topical(spark, d), "cefr_level", "topic", ["dataset"]), ["dataset"]))
    return full.groupBy("dataset").agg(F.count_if(F.abs("std_residual") > 2).alias("over_2"), F.count_if(F.abs("std_residual") > 3).alias("over_3"))


@query(_ALL + ", e AS (SELECT x, y, (n - r * c_ / t) / sqrt(r * c_ / t * (1 - r / t) * (1 - c_ / t)) AS z FROM gr) SELECT x AS level, y AS topic, round(z, 6) AS std_residual FROM e WHERE z > 0 ORDER BY z DESC, x, y LIMIT 12")
def top_associations(spark, d):
    full = A.residuals(A.grid(A.cells_of(topical(spark, d), "cefr_level", "topic")))
    top = full.where("std_residual > 0").orderBy(F.desc("std_residual"), "x", "y").limit(12)
    return rounded(top, "std_residual").select(F.col("x").alias("level"), F.col("y").alias("topic"), "std_residual")


@query(_ALL + """, e AS (SELECT x, y, n, r * c_ / t AS e, (n - r * c_ / t) / sqrt(r * c_ / t * (1 - r / t) * (1 - c_ / t)) AS z FROM gr),
s AS (SELECT 'absolute' AS side, row_number() OVER (ORDER BY round(abs(z), 9) DESC, x, y) AS place, * FROM e UNION ALL SELECT 'over', row_number() OVER (ORDER BY round(z, 9) DESC, x, y), * FROM e WHERE z > 0 UNION ALL SELECT 'under', row_number() OVER (ORDER BY round(z, 9), x, y), * FROM e WHERE z < 0)
SELECT side, place, x AS level, y AS topic, topic_label AS label, n AS observed, round(e, 1) AS expected, round(n / e, 2) AS obs_over_exp, round(z, 2) AS std_residual FROM s LEFT JOIN topics_top_words_de ON topic = y WHERE side = 'absolute' OR side = 'over' AND place <= 10 OR side = 'under' AND place <= 6""")
def extreme_residuals(spark, d):
    """All cells by absolute residual, the ten most over- and the six most underrepresented ones, with the label of the topic and rounded as in a report."""
    e = Workspace(spark).save(A.residuals(A.grid(A.cells_of(topical(spark, d), "cefr_level", "topic"))))
    z = F.round("std_residual", 9)
    sides = (("absolute", F.desc(F.abs(z)), None, e), ("over", F.desc(z), 10, e.where("std_residual > 0")), ("under", F.asc(z), 6, e.where("std_residual < 0")))
    out = None
    for side, by, most, part in sides:
        # a report over the cells, of which there are levels x topics
        ranked = part.withColumn("place", F.row_number().over(Window.orderBy(by, "x", "y")).cast("bigint")).withColumn("side", F.lit(side))
        ranked = ranked.where(F.col("place") <= most) if most else ranked
        out = ranked if out is None else out.union(ranked)
    labels = table(spark, d, "topics_top_words_de").select(F.col("topic").alias("y"), F.col("topic_label").alias("label"))
    full = out.join(F.broadcast(labels), "y", "left")
    return full.select("side", "place", F.col("x").alias("level"), F.col("y").alias("topic"), "label", F.col("n").alias("observed"), (F.round("expected", 1) + F.lit(0.0)).alias("expected"), (F.round("obs_over_exp", 2) + F.lit(0.0)).alias("obs_over_exp"), (F.round("std_residual", 2) + F.lit(0.0)).alias("std_residual"))


@query(f"""WITH {CLEAN}, z AS (SELECT cefr_level AS x, topic AS y, dataset AS g FROM texts WHERE topic IS NOT NULL), cell AS (SELECT g, x, y, count(*) AS n FROM z GROUP BY ALL),
tot AS (SELECT g, sum(n) AS t, count(DISTINCT x) AS lv FROM cell GROUP BY g), mem AS (SELECT g, x, sum(n) AS m FROM cell GROUP BY ALL), top AS (SELECT g, y, sum(n) AS c FROM cell GROUP BY ALL)
SELECT x AS level, g AS stratum, y AS topic, c::BIGINT AS n, coalesce(cell.n, 0) AS observed, round(c * m / t, 6) AS expected, t::BIGINT AS total, m::BIGINT AS members FROM mem JOIN tot USING (g) JOIN top USING (g) LEFT JOIN cell USING (g, x, y) WHERE lv > 1 AND t > 1 AND m < t""")
def cmh_terms(spark, d):
    return rounded(A.mantel_haenszel(topical(spark, d), "cefr_level", "topic", "dataset"), "expected")


@query(f"""WITH {CLEAN}, c AS (SELECT topic, cefr_level, dataset FROM texts WHERE topic IS NOT NULL),
l AS (SELECT topic, cefr_level, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, cefr_level) AS k FROM c GROUP BY topic, cefr_level), s AS (SELECT topic, dataset, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, dataset) AS k FROM c GROUP BY topic, dataset), t AS (SELECT topic, count(*) AS n FROM c GROUP BY topic)
SELECT topic, t.n AS n, l.cefr_level AS dominant_level, round(l.n / t.n, 6) AS level_share, s.dataset AS dominant_source, round(s.n / t.n, 6) AS source_share, top_words FROM t JOIN l USING (topic) JOIN s USING (topic) LEFT JOIN topics_top_words_de USING (topic) WHERE l.k = 1 AND s.k = 1""")
def topic_summary(spark, d):
    texts = measured(spark, d).where("topic is not null")
    level = A.dominant(A.cells_of(texts, "cefr_level", "topic")).select(F.col("y").alias("topic"), "n", F.col("dominant").alias("dominant_level"), F.col("share").alias("level_share"))
    source = A.dominant(A.cells_of(texts, "dataset", "topic")).select(F.col("y").alias("topic"), F.col("dominant").alias("dominant_source"), F.col("share").alias("source_share"))
    words = table(spark, d, "topics_top_words_de").select("topic", "top_words")
    return rounded(level.join(source, "topic").join(F.broadcast(words), "topic", "left"), "level_share", "source_share")


@query(f"WITH {CLEAN}, c AS (SELECT topic, cefr_level, count(*) AS n FROM texts WHERE topic IS NOT NULL GROUP BY ALL) SELECT topic, cefr_level, n, round(n / sum(n) OVER (PARTITION BY topic), 6) AS of_topic, round(n / sum(n) OVER (PARTITION BY cefr_level), 6) AS of_level FROM c")
def level_shares(spark, d):
    c = topical(spark, d).groupBy("topic", "cefr_level").agg(F.count("*").alias("n"))
    return rounded(c.withColumn("of_topic", R.share_of("n", ["topic"])).withColumn("of_level", R.share_of("n", ["cefr_level"])), "of_topic", "of_level")


_RANKED = "(SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2 AS rb FROM z)"


@query(f"WITH {CLEAN}, z AS (SELECT dataset AS g, word_count AS a, level_rank AS b FROM texts) SELECT g AS dataset, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM {_RANKED} GROUP BY g")
def length_level_spearman(spark, d):
    return rounded(R.spearman(texts_of(spark, d), "word_count", "level_rank", ["dataset"]), "rho")


@query(f"WITH {CLEAN}, z AS (SELECT 1 AS g, word_count AS a, level_rank AS b FROM texts) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM {_RANKED}")
def length_level_spearman_overall(spark, d):
    return rounded(R.spearman(texts_of(spark, d), "word_count", "level_rank"), "rho")


@query("SELECT o_totalprice, count(*) AS n, sum(count(*)) OVER (ORDER BY o_totalprice) - count(*) + (count(*) + 1) / 2 AS rank FROM orders GROUP BY o_totalprice")
def average_ranks(spark, d):
    return R.average_ranks(table(spark, d, "orders"), "o_totalprice")


def _bins(q: int) -> str:
    points = ", ".join(f"quantile_cont(word_count, {k / q}) OVER (PARTITION BY dataset)" for k in range(q + 1))
    return f"b AS (SELECT row_id, dataset, cefr_level, level_rank, topic, word_count, greatest(1, len(list_filter(list_distinct([{points}]), lambda e: e < word_count)))::INTEGER AS bin FROM texts)"


@query(f"WITH {CLEAN}, {_bins(4)} SELECT dataset, bin, count(*) AS n, min(word_count) AS low, max(word_count) AS high, median(word_count) AS median, {', '.join(f'count_if(cefr_level = {chr(39)}{v}{chr(39)}) AS {v}' for v in LEVELS)} FROM b GROUP BY dataset, bin")
def length_bins(spark, d):
    binned = R.quantile_bins(measured(spark, d), "word_count", 4, ["dataset"])
    return binned.groupBy("dataset", "bin").agg(F.count("*").alias("n"), F.min("word_count").alias("low"), F.max("word_count").alias("high"), F.median("word_count").alias("median"), *[F.count_if(F.col("cefr_level") == v).alias(v) for v in LEVELS])


_BIN_V = f"z AS (SELECT dataset || '/' || bin AS g, cefr_level AS x, topic AS y FROM b), {_GRID}, {_V}"


@query(f"WITH {CLEAN}, {_bins(4)}, {_BIN_V} SELECT g AS stratum, n, r AS rows, k AS columns, {_VS} FROM cor")
def association_by_length_bin(spark, d):
    binned = R.quantile_bins(measured(spark, d), "word_count", 4, ["dataset"]).where("topic is not null").withColumn("stratum", F.concat_ws("/", "dataset", "bin"))
    return rounded(A.chi_square(A.cells_of(binned, "cefr_level", "topic", ["stratum"]), ["stratum"]), "chi2", "v", "v_uncorrected")


@query(f"WITH {CLEAN}, {_bins(10)}, {_BIN_V}, w AS (SELECT split_part(g, '/', 1) AS dataset, CASE WHEN least(rc - 1, kc - 1) > 0 THEN sqrt(phi / least(rc - 1, kc - 1)) ELSE 0 END AS v FROM cor WHERE r > 1 AND k > 1) SELECT dataset, count(*) AS bins, round(avg(v), 6) AS mean_v FROM w GROUP BY dataset")
def mean_decile_association(spark, d):
    binned = R.quantile_bins(measured(spark, d), "word_count", 10, ["dataset"]).where("topic is not null")
    v = A.chi_square(A.cells_of(binned, "cefr_level", "topic", ["dataset", "bin"]), ["dataset", "bin"]).where("rows > 1 and columns > 1")
    return rounded(v.groupBy("dataset").agg(F.count("*").alias("bins"), F.avg("v").alias("mean_v")), "mean_v")


@query("WITH t AS (SELECT batch_id, dataset, cefr_level, 1.0 / (1 + n % 97) AS p FROM descriptives_de WHERE cefr_level <> 'ALL'), o AS (SELECT *, row_number() OVER (ORDER BY p, batch_id, dataset, cefr_level) AS i, count(*) OVER () AS m FROM t) SELECT batch_id, dataset, cefr_level, round(p::DOUBLE, 6) AS p, round(max(least(1, (m - i + 1) * p::DOUBLE)) OVER (ORDER BY i), 6) AS p_holm FROM o")
def holm_adjustment(spark, d):
    tests = table(spark, d, "descriptives_de").where("cefr_level <> 'ALL'").select("batch_id", "dataset", "cefr_level", (1 / (1 + F.col("n") % 97)).alias("p"))
    return rounded(R.holm(tests), "p", "p_holm")


def length_rule(spark, d) -> DataFrame:
    """A rule in place of a model: the predicted level is the sixth of its corpus's lengths that a text is in."""
    binned = R.quantile_bins(measured(spark, d), "word_count", 6, ["dataset"])
    return binned.select("dataset", F.col("level_rank").alias("y_true"), (F.col("bin") - 1).alias("y_pred"))


_RULE = f"WITH {CLEAN}, {_bins(6)}, cf AS (SELECT dataset AS g, level_rank AS a, bin - 1 AS p, count(*) AS n FROM b GROUP BY ALL)"
_CLASS = """ta AS (SELECT g, a AS l, sum(n) AS s, sum(n) FILTER (a = p) AS h FROM cf GROUP BY ALL), pa AS (SELECT g, p AS l, sum(n) AS q FROM cf GROUP BY ALL),
pc AS (SELECT g, l, coalesce(s, 0)::BIGINT AS s, coalesce(q, 0)::BIGINT AS q, coalesce(h, 0)::BIGINT AS h FROM ta FULL JOIN pa USING (g, l))"""


@query(_RULE + ", " + _CLASS + " SELECT g AS dataset, l::INTEGER AS level, s AS support, q AS predicted_n, round(coalesce(h / nullif(q, 0), 0), 6) AS precision, round(coalesce(h / nullif(s, 0), 0), 6) AS recall, round(coalesce(2 * h / nullif(s + q, 0), 0), 6) AS f1 FROM pc")
def class_report(spark, d):
    return rounded(M.per_class(M.confusion(length_rule(spark, d), ["dataset"]), ["dataset"]), "precision", "recall", "f1")


@query(_RULE + ", " + _CLASS + """, lv AS (SELECT DISTINCT g, unnest([a, p]) AS l FROM cf), pos AS (SELECT g, l, dense_rank() OVER (PARTITION BY g ORDER BY l) AS i FROM lv),
pl AS (SELECT g, x.i, y.i AS j, n FROM cf JOIN pos x USING (g) JOIN pos y USING (g) WHERE x.l = a AND y.l = p), ex AS (SELECT g, sum(r * c * (i - j) ** 2) AS e FROM (SELECT g, i, sum(n) AS r FROM pl GROUP BY ALL) JOIN (SELECT g, j, sum(n) AS c FROM pl GROUP BY ALL) USING (g) GROUP BY g), ob AS (SELECT g, sum(n * (i - j) ** 2) AS o, sum(n) AS t FROM pl GROUP BY g),
f AS (SELECT g, avg(coalesce(2 * h / nullif(s + q, 0), 0)) AS mf, sum(coalesce(2 * h / nullif(s + q, 0), 0) * s) / sum(s) AS wf FROM pc GROUP BY g), b2 AS (SELECT g, sum(n)::BIGINT AS n, sum(CASE WHEN a = p THEN n ELSE 0 END) / sum(n) AS acc, sum(CASE WHEN abs(a - p) <= 1 THEN n ELSE 0 END) / sum(n) AS adj FROM cf GROUP BY g)
SELECT g AS dataset, n, round(acc, 6) AS accuracy, round(adj, 6) AS adjacent_accuracy, round(mf, 6) AS macro_f1, round(wf, 6) AS weighted_f1, round(1 - o * t / e, 6) AS qwk FROM b2 JOIN f USING (g) JOIN ob USING (g) JOIN ex USING (g)""")
def metric_summary(spark, d):
    return rounded(M.summary(M.confusion(length_rule(spark, d), ["dataset"]), ["dataset"]), "accuracy", "adjacent_accuracy", "macro_f1", "weighted_f1", "qwk")


@query(_RULE + " SELECT a::INTEGER AS y_true, " + ", ".join(f"coalesce(sum(n) FILTER (p = {k}), 0)::BIGINT AS p{k}" for k in range(6)) + " FROM cf GROUP BY a")
def confusion_matrix(spark, d):
    cells = M.confusion(length_rule(spark, d))
    return cells.groupBy("y_true").agg(*[F.coalesce(F.sum(F.when(F.col("y_pred") == k, F.col("n"))), F.lit(0)).alias(f"p{k}") for k in range(6)])


@query("SELECT dataset, round((weighted_f1 - 0.268) / (0.732 - 0.268), 6) AS calibrated FROM (" + SQL["metric_summary"] + ")")
def calibrated_rule(spark, d):
    """Where the weighted F1 of the length rule lies between a published floor and ceiling."""
    return metric_summary(spark, d).select("dataset", F.round(calibration(F.col("weighted_f1"), 0.268, 0.732), 6).alias("calibrated"))


@query(f"WITH {CLEAN}, c AS (SELECT dataset, cefr_level, count(*) AS n FROM texts GROUP BY ALL), m AS (SELECT dataset, first(cefr_level ORDER BY n DESC, list_position(['A1','A2','B1','B2','C1','C2'], cefr_level)) AS majority, max(n) AS hit, sum(n) AS t FROM c GROUP BY dataset) SELECT dataset, majority, round(hit / t, 6) AS accuracy FROM m")
def majority_class(spark, d):
    c = texts_of(spark, d).groupBy("dataset", "cefr_level", "level_rank").agg(F.count("*").alias("n"))
    m = c.groupBy("dataset").agg(F.min(F.struct((-F.col("n")).alias("k"), "level_rank", "cefr_level")).alias("m"), F.sum("n").alias("t"))
    return rounded(m.select("dataset", F.col("m.cefr_level").alias("majority"), (-F.col("m.k") / F.col("t")).alias("accuracy")), "accuracy")


@query(f"""WITH {CLEAN}, f AS (SELECT dataset, (('0x' || md5('42/' || row_id)[1:8])::BIGINT % 5)::INTEGER AS fold, count(*) AS n FROM texts GROUP BY ALL), s AS (SELECT dataset, n_all / sum(n_all) OVER () AS p FROM (SELECT dataset, sum(n) AS n_all FROM f GROUP BY dataset)),
q AS (SELECT k.fold, s.dataset, coalesce(f.n, 0) / t.t AS p2, s.p FROM (SELECT DISTINCT fold FROM f) k CROSS JOIN s JOIN (SELECT fold, sum(n) AS t FROM f GROUP BY fold) t ON t.fold = k.fold LEFT JOIN f ON f.fold = k.fold AND f.dataset = s.dataset) SELECT fold, round(sum(abs(p - p2)) / 2, 6) AS tvd FROM q GROUP BY fold""")
def fold_mix_distance(spark, d):
    fold = (F.conv(F.substring(F.md5(F.concat(F.lit("42/"), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("bigint") % 5).cast("int")
    f = texts_of(spark, d).groupBy("dataset", fold.alias("fold")).agg(F.count("*").alias("n"))
    overall = f.groupBy("dataset").agg(F.sum("n").alias("a"))
    t = f.groupBy("fold").agg(F.sum("n").alias("t"))
    g = t.crossJoin(overall).crossJoin(overall.agg(F.sum("a").alias("all"))).join(f, ["fold", "dataset"], "left")  # folds by corpora
    return rounded(g.groupBy("fold").agg((F.sum(F.abs(F.coalesce("n", F.lit(0)) / F.col("t") - F.col("a") / F.col("all"))) / 2).alias("tvd")), "tvd")


@query("""WITH p AS (SELECT least(i, j)::BIGINT AS i, greatest(i, j)::BIGINT AS j, max(similarity) AS similarity, bool_or(level_i <> level_j) AS mismatch FROM near_duplicates_de WHERE similarity IS NOT NULL AND j IS NOT NULL AND i <> j GROUP BY 1, 2)
SELECT t.threshold::DOUBLE AS threshold, count_if(similarity >= t.threshold) AS pairs, count_if(similarity >= t.threshold AND mismatch) AS mismatches FROM p, (SELECT unnest([0.5, 0.7, 0.8, 0.85, 0.9]) AS threshold) t GROUP BY 1""")
def similarity_thresholds(spark, d):
    i, j = F.col("i"), F.col("j").cast("bigint")
    p = table(spark, d, "near_duplicates_de").where("similarity is not null and j is not null and i <> j").groupBy(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).agg(F.max("similarity").alias("similarity"), F.max(F.col("level_i") != F.col("level_j")).alias("mismatch"))
    each = p.select(F.explode(F.array(*map(F.lit, (0.5, 0.7, 0.8, 0.85, 0.9)))).alias("threshold"), "similarity", "mismatch")
    return each.groupBy("threshold").agg(F.count_if(F.col("similarity") >= F.col("threshold")).alias("pairs"), F.count_if((F.col("similarity") >= F.col("threshold")) & F.col("mismatch")).alias("mismatches"))


@query("""SELECT CASE WHEN dataset_i <= dataset_j THEN dataset_i || ' | ' || dataset_j ELSE dataset_j || ' | ' || dataset_i END AS pair, count(*) AS n, count_if(same_corpus) AS same, round(avg(similarity), 6) AS mean_similarity FROM near_duplicates_de WHERE dataset_i IS NOT NULL AND dataset_j IS NOT NULL AND similarity >= 0.85 GROUP BY 1""")
def near_duplicates_by_corpora(spark, d):
    pair = F.array_join(F.array_sort(F.array("dataset_i", "dataset_j")), " | ")
    rows = table(spark, d, "near_duplicates_de").where("dataset_i is not null and dataset_j is not null and similarity >= 0.85")
    return rounded(rows.groupBy(pair.alias("pair")).agg(F.count("*").alias("n"), F.count_if("same_corpus").alias("same"), F.avg("similarity").alias("mean_similarity")), "mean_similarity")

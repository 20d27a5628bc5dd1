"""Queries over corpora: cleaning, duplicates, text functions and descriptives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textwerk.functions import text as T
from textwerk.operators import clean as C
from textwerk.operators.durable import table
from textwerk.operators.ranks import top_per_group
from textwerk.plans.named import registrar

#: White space as the inside of a class of the SQL side's pattern language.
_S = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = rf"regexp_replace(%s, '^[{_S}]+|[{_S}]+$', '', 'g')"
WHITE_SPACE_TOKENS = rf"list_filter(regexp_split_to_array(%s, '[{_S}]+'), lambda t: t <> '')"
_LEVEL = rf"CASE WHEN regexp_extract(upper({_STRIP % 'cefr_level'}), '^(PRE-A1|A1|A2|B1|B2|C1|C2)\s*(\+|\.\d+)?$', 1) IN ('A1','A2','B1','B2','C1','C2') THEN regexp_extract(upper({_STRIP % 'cefr_level'}), '^(PRE-A1|A1|A2|B1|B2|C1|C2)\s*(\+|\.\d+)?$', 1) END"
#: Common table expressions of the SQL side: labelled rows, those of enough tokens, clean texts.
LABELLED = f"""labelled AS (SELECT * FROM (SELECT row_id, {_STRIP % "text"} AS text, {_LEVEL} AS cefr_level, source_name, format, category, pair_id, title, dataset, topic, topic_strength, cv_group FROM combined_csv) WHERE cefr_level IS NOT NULL AND text IS NOT NULL),
long AS (SELECT *, CAST(len({WHITE_SPACE_TOKENS % "text"}) AS INTEGER) AS word_count FROM labelled WHERE len({WHITE_SPACE_TOKENS % "text"}) >= 10)"""
CLEAN = (
    LABELLED
    + f""",
marked AS (SELECT *, min(dataset) OVER w AS d0, max(dataset) OVER w AS d1, min(cefr_level) OVER w AS l0, max(cefr_level) OVER w AS l1, row_number() OVER (PARTITION BY text ORDER BY row_id) AS k FROM long WINDOW w AS (PARTITION BY text)),
texts AS (SELECT row_id, text, cefr_level, source_name, dataset, topic, topic_strength, word_count,
  CASE WHEN pair_id IS NULL OR {_STRIP % "pair_id"} IN ('', 'nan') THEN dataset || '__' || row_id ELSE pair_id END AS pair_id,
  list_position(['A1','A2','B1','B2','C1','C2'], cefr_level) - 1 AS level_rank FROM marked WHERE d0 = d1 AND l0 = l1 AND k = 1)"""
)

QUERIES, SQL, query = registrar()


def texts_of(spark: SparkSession, d: str) -> DataFrame:
    """Clean texts with ``level_rank``."""
    return C.clean_texts(table(spark, d, "combined_csv")).withColumn("level_rank", C.level_rank(F.col("cefr_level")))


@query(f"WITH {CLEAN} SELECT row_id, sha256(text) AS text_sha256, cefr_level, dataset, pair_id, word_count FROM texts")
def clean_texts(spark, d):
    return texts_of(spark, d).select("row_id", F.sha2("text", 256).alias("text_sha256"), "cefr_level", "dataset", "pair_id", "word_count")


@query(rf"""WITH {LABELLED},
t AS (SELECT text, count(*) AS n, count(DISTINCT dataset || '/' || cefr_level) AS kinds FROM long GROUP BY text)
SELECT (SELECT count(*) FROM combined_csv) AS n_start, (SELECT count(*) FROM combined_csv WHERE regexp_matches({_STRIP % "cefr_level"}, '(\+|\.\d)$')) AS n_sublevel,
(SELECT count(*) FROM combined_csv) - (SELECT count(*) FROM labelled) AS n_unusable, (SELECT count(*) FROM labelled) - (SELECT count(*) FROM long) AS n_short,
(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM t WHERE kinds > 1) AS n_conflicting, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM t WHERE kinds = 1) AS n_redundant, (SELECT count(*) FROM t WHERE kinds = 1) AS n_kept""")
def cleaning_stages(spark, d):
    return C.stage_counts(table(spark, d, "combined_csv"))


@query(f"""WITH {LABELLED} SELECT sha256(text) AS text_sha256, CAST(count(*) AS INTEGER) AS n_rows, CAST(count(DISTINCT dataset) AS INTEGER) AS n_corpora, CAST(count(DISTINCT cefr_level) AS INTEGER) AS n_levels,
string_agg(DISTINCT dataset, '|' ORDER BY dataset) AS datasets, string_agg(DISTINCT cefr_level, '|' ORDER BY cefr_level) AS levels,
CASE WHEN count(DISTINCT dataset) > 1 OR count(DISTINCT cefr_level) > 1 THEN 'exclude_all_conflicting_rows' ELSE 'keep_first_redundant_copy' END AS action FROM long GROUP BY text HAVING count(*) > 1""")
def duplicate_audit(spark, d):
    return C.duplicate_audit(table(spark, d, "combined_csv"))


@query(f"WITH x AS (SELECT cefr_level AS raw, {_LEVEL} AS level FROM combined_csv) SELECT raw, level, count(*) AS n FROM x GROUP BY ALL")
def level_normalization(spark, d):
    return table(spark, d, "combined_csv").groupBy(F.col("cefr_level").alias("raw"), C.normalize_level(F.col("cefr_level")).alias("level")).agg(F.count("*").alias("n"))


@query("SELECT dataset, cefr_level, count(*) AS n FROM (SELECT DISTINCT ON (source_name) source_name, dataset, cefr_level FROM combined_csv WHERE source_name IS NOT NULL ORDER BY source_name, row_id) GROUP BY ALL")
def first_row_per_source(spark, d):
    return C.first_per_key(table(spark, d, "combined_csv").where("source_name is not null"), "source_name", "row_id").groupBy("dataset", "cefr_level").agg(F.count("*").alias("n"))


@query(rf"""SELECT doc_id, CAST(len({WHITE_SPACE_TOKENS % "text"}) AS INTEGER) AS n_tokens,
CASE WHEN regexp_matches(text, '[^{_S}]') THEN greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+[\s\x0b"]+'), lambda p: regexp_matches(p, '[^{_S}]')))) ELSE 0 END::INTEGER AS n_sentences,
greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda p: regexp_matches(p, '[^{_S}]'))))::INTEGER AS n_marks,
round(coalesce(list_sum(list_transform({WHITE_SPACE_TOKENS % "text"}, lambda t: length(t))) / nullif(len({WHITE_SPACE_TOKENS % "text"}), 0), 0), 6)::DOUBLE AS mean_word_len,
CASE WHEN len({WHITE_SPACE_TOKENS % "text"}) >= 20 THEN round(len(list_distinct(({WHITE_SPACE_TOKENS % "lower(text)"})[1:200])) / least(200, len({WHITE_SPACE_TOKENS % "text"})), 6) END AS ttr_200,
round(ln(1 + len({WHITE_SPACE_TOKENS % "text"})), 6) AS log_tokens, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL""")
def text_features(spark, d):
    t = F.col("text")
    words = T.tokens(t)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(words).alias("n_tokens"), T.sentence_count(t).alias("n_sentences"), T.sentence_marks(t).alias("n_marks"), F.round(T.mean_length(words), 6).alias("mean_word_len"), F.round(T.type_token_ratio(t), 6).alias("ttr_200"), F.round(F.log1p(F.size(words)), 6).alias("log_tokens"), F.sha2(t, 256).alias("text_sha256"))


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x0b]+([.,;:!?%)\]])', '\1', 'g'), '([(\[])[\s\x0b]+', '\1', 'g'), '[\s\x0b]+', ' ', 'g'))) AS detokenized FROM documents WHERE text IS NOT NULL""")
def detokenized_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.detokenize(F.col("text")), 256).alias("detokenized"))


def descriptives_over(rows: DataFrame) -> DataFrame:
    """Descriptives of (dataset, level), (dataset, ``ALL``) and (``ALL``, ``ALL``) in one pass over grouping sets."""
    t = F.col("text")
    words = T.tokens(t)
    base = rows.select("dataset", "cefr_level", F.size(words).alias("tok"), T.sentence_count(t).alias("sen"), T.type_token_ratio(t).alias("ttr"), T.mean_length(words).alias("len"))
    sets = base.groupingSets([[F.col("dataset"), F.col("cefr_level")], [F.col("dataset")], []], F.col("dataset"), F.col("cefr_level"))
    return sets.agg(F.grouping("dataset").alias("_g"), F.grouping("cefr_level").alias("_h"), F.count("*").alias("n"), F.round(F.avg("tok"), 6).alias("tokens_mean"), F.median("tok").alias("tokens_median"), F.round(F.percentile("tok", 0.75) - F.percentile("tok", 0.25), 6).alias("tokens_iqr"), F.min("tok").alias("tokens_min"), F.max("tok").alias("tokens_max"), F.median("sen").alias("sentences_median"), F.round(F.avg("ttr"), 6).alias("ttr_200_mean"), F.round(F.avg("len"), 6).alias("mean_word_len")).withColumn("dataset", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("dataset"))).withColumn("cefr_level", F.when(F.col("_h") == 1, "ALL").otherwise(F.col("cefr_level"))).drop("_g", "_h")


_BASE = rf"""base AS (SELECT dataset, cefr_level, word_count AS tok,
CASE WHEN regexp_matches(text, '[^{_S}]') THEN greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+[\s\x0b"]+'), lambda p: regexp_matches(p, '[^{_S}]')))) ELSE 0 END AS sen,
CASE WHEN word_count >= 20 THEN len(list_distinct(({WHITE_SPACE_TOKENS % "lower(text)"})[1:200])) / least(200, word_count) END AS ttr,
list_sum(list_transform({WHITE_SPACE_TOKENS % "text"}, lambda t: length(t))) / word_count AS len FROM texts)"""


@query(f"""WITH {CLEAN}, {_BASE} SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS dataset, CASE WHEN grouping(cefr_level) = 1 THEN 'ALL' ELSE cefr_level END AS cefr_level, count(*) AS n,
round(avg(tok), 6) AS tokens_mean, median(tok) AS tokens_median, round(quantile_cont(tok, 0.75) - quantile_cont(tok, 0.25), 6) AS tokens_iqr, min(tok) AS tokens_min, max(tok) AS tokens_max, median(sen) AS sentences_median, round(avg(ttr), 6) AS ttr_200_mean, round(avg(len), 6) AS mean_word_len
FROM base GROUP BY GROUPING SETS ((dataset, cefr_level), (dataset), ())""")
def descriptives(spark, d):
    return descriptives_over(texts_of(spark, d))


@query(f"WITH {CLEAN}, p AS (SELECT pair_id, count(*) AS size FROM texts GROUP BY pair_id) SELECT size, count(*) AS n FROM p GROUP BY size")
def pair_size_histogram(spark, d):
    return texts_of(spark, d).groupBy("pair_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(f"WITH {CLEAN} SELECT dataset, " + ", ".join(f"count_if(cefr_level = '{v}') AS {v}" for v in C.LEVELS) + " FROM texts GROUP BY dataset")
def level_by_dataset(spark, d):
    return texts_of(spark, d).groupBy("dataset").pivot("cefr_level", list(C.LEVELS)).count().na.fill(0)


@query(f"WITH {CLEAN} SELECT dataset, cefr_level, count(*) AS n, round(avg(word_count), 6) AS mean, median(word_count) AS median, quantile_cont(word_count, 0.25) AS q25, quantile_cont(word_count, 0.75) AS q75 FROM texts GROUP BY dataset, cefr_level")
def length_by_level(spark, d):
    return texts_of(spark, d).groupBy("dataset", "cefr_level").agg(F.count("*").alias("n"), F.round(F.avg("word_count"), 6).alias("mean"), F.median("word_count").alias("median"), F.percentile("word_count", 0.25).alias("q25"), F.percentile("word_count", 0.75).alias("q75"))


@query(f"WITH {CLEAN}, s AS (SELECT cefr_level, min(n) AS low FROM (SELECT d.dataset, l.cefr_level, (SELECT count(*) FROM texts t WHERE t.dataset = d.dataset AND t.cefr_level = l.cefr_level) AS n FROM (SELECT DISTINCT dataset FROM texts) d, (SELECT DISTINCT cefr_level FROM texts) l) GROUP BY cefr_level) SELECT dataset, round(avg(CASE WHEN cefr_level IN (SELECT cefr_level FROM s WHERE low >= 5) THEN 1 ELSE 0 END), 6) AS coverage FROM texts GROUP BY dataset")
def common_level_coverage(spark, d):
    texts = texts_of(spark, d).select("dataset", "cefr_level")
    common = C.common_levels(texts).withColumn("_in", F.lit(1))
    return texts.join(F.broadcast(common), "cefr_level", "left").groupBy("dataset").agg(F.round(F.avg(F.coalesce("_in", F.lit(0))), 6).alias("coverage"))


@query(f"WITH {CLEAN} SELECT cefr_level, count(*) AS n FROM texts WHERE topic_strength >= (SELECT median(topic_strength) FROM texts) GROUP BY cefr_level")
def confident_half_levels(spark, d):
    return C.confident_half(texts_of(spark, d)).groupBy("cefr_level").agg(F.count("*").alias("n"))


@query(f"WITH {CLEAN} SELECT cefr_level, count(*) AS n FROM texts WHERE dataset = 'merlin_de' AND cefr_level IN (SELECT cefr_level FROM texts WHERE dataset = 'merlin_de' GROUP BY 1 HAVING count(*) >= 5) GROUP BY cefr_level")
def supported_levels(spark, d):
    return C.supported_levels(texts_of(spark, d).where("dataset = 'merlin_de'")).groupBy("cefr_level").agg(F.count("*").alias("n"))


@query("SELECT topic, concat_ws('/', split_part(top_words, ', ', 1), split_part(top_words, ', ', 2), split_part(top_words, ', ', 3)) AS label, len(string_split(top_words, ', '))::INTEGER AS n_words FROM topics_top_words_de")
def topic_labels(spark, d):
    return table(spark, d, "topics_top_words_de").select("topic", T.short_label(F.col("top_words")).alias("label"), F.size(F.split("top_words", ", ")).alias("n_words"))


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings), a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)) AS v, embedding FROM e)
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS top_axis, (list_position(v, list_max(v)) - 1)::INTEGER AS strongest_axis, round(list_max(v)::DOUBLE, 6) AS strength FROM a""")
def strongest_axis(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", T.argmax(e).alias("top_axis"), T.argmax(e, absolute=True).alias("strongest_axis"), F.round(F.array_max(F.transform(e, F.abs)).cast("double"), 6).alias("strength"))


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / list_sum(v)) * (x / list_sum(v)))), 6) AS concentration FROM a""")
def normalised_weights(spark, d):
    w = T.l1_normalised(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x), 6).alias("concentration"))


@query("SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'documents' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'combined', row_id FROM combined_csv) GROUP BY kind")
def union_by_name(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "lang")
    b = table(spark, d, "combined_csv").select(F.lit("combined").alias("kind"), F.col("row_id").alias("id"), "dataset")
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("""SELECT side, cefr_level, count(*) AS n FROM (SELECT 'title' AS side, title AS text, cefr_level FROM combined_csv UNION ALL SELECT 'body', text, cefr_level FROM combined_csv) WHERE regexp_matches(text, '[^""" + _S + """]') AND lower(trim(cefr_level)) <> 'nan' GROUP BY ALL""")
def side_by_side(spark, d):
    return C.side_by_side(table(spark, d, "combined_csv"), {"title": {"text": "title", "cefr_level": "cefr_level"}, "body": {"text": "text", "cefr_level": "cefr_level"}}).groupBy("side", "cefr_level").agg(F.count("*").alias("n"))


@query(rf"""WITH t AS (SELECT topic, unnest(string_split(top_words, ', ')) AS word, generate_subscripts(string_split(top_words, ', '), 1) AS place FROM topics_top_words_de), k AS (SELECT * FROM t WHERE place <= 5) SELECT round(count(DISTINCT word) / count(*), 6) AS diversity FROM k""")
def topic_diversity(spark, d):
    words = table(spark, d, "topics_top_words_de").select("topic", F.posexplode(F.split("top_words", ", ")).alias("place", "word"))
    return top_per_group(words, ["topic"], [F.col("place")], 5).agg(F.round(F.count_distinct("word") / F.count("*"), 6).alias("diversity"))

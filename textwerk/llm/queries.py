"""The queries of this subpackage, by name, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textwerk.llm.components import peeled_components
from textwerk.llm.families import families, split_rows
from textwerk.llm.levels import disagreeing, fitted, reading_levels, word_difficulties
from textwerk.llm.lookalikes import form_classes, forms, unlike_pairs
from textwerk.llm.near import near_classes, near_pairs
from textwerk.llm.packing import packed
from textwerk.llm.prose import judged, text_statistics
from textwerk.llm.subjects import dealt_with, text_subjects
from textwerk.llm.tokens import encoded, token_counts, tokenizer_path
from textwerk.llm.writings import collapsed, same_writing
from textwerk.operators.durable import Workspace, table
from textwerk.operators.skew import heavy_keys, split_join
from textwerk.plans.corpus import WHITE_SPACE_TOKENS

#: A recorded pair links its rows from this similarity on.
LINK_SIMILARITY = 0.85


#: Texts are near duplicates from this share of common shingles on.
ALIKE = {"threshold": 0.6, "size": 3, "least_words": 10}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(*near_classes(table(spark, d, "combined_csv"), **ALIKE))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """For every compared row its class of equal shingle sets, the number of classes linked to it, and its group."""
    members, links = near_classes(table(spark, d, "combined_csv"), **ALIKE)
    first = members.groupBy("key").agg(F.min("row_id").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    groups = peeled_components(links, "a", "b").withColumnRenamed("vertex", "key")
    known = first.join(degree, "key", "left").join(groups, "key", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "key").alias("label"))
    low = known.groupBy("label").agg(F.min("class_id").alias("group_id"))
    whole = split_join(known, low, "label", heavy_keys(known, "label"))
    return split_join(members, whole, "key", heavy_keys(members, "key")).select("row_id", "class_id", "n_links", "group_id")


def recorded_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near_duplicates_de that link two rows of combined_csv."""
    pairs = table(spark, d, "near_duplicates_de").where(F.col("similarity") >= LINK_SIMILARITY).where("i <> j").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).distinct()
    ids = table(spark, d, "combined_csv").select(F.col("row_id").cast("bigint").alias("row_id")).distinct()
    return pairs.join(ids.withColumnRenamed("row_id", "i"), "i", "left_semi").join(ids.withColumnRenamed("row_id", "j"), "j", "left_semi")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = peeled_components(recorded_links(spark, d))
    return found.where("label < vertex").select(F.col("label").alias("first_row_id"), F.col("vertex").alias("row_id"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its group; unlinked rows are groups of their own."""
    found = peeled_components(recorded_links(spark, d))
    ids = table(spark, d, "combined_csv").select("row_id")
    return ids.join(found.withColumnRenamed("vertex", "row_id"), "row_id", "left").select("row_id", F.concat(F.lit("cv_"), F.coalesce("label", "row_id").cast("string")).alias("cv_group"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return same_writing(table(spark, d, "combined_csv"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(table(spark, d, "combined_csv"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return families(table(spark, d, "combined_csv")).where("family < row_id").select(F.col("family").alias("first_row_id"), "row_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return split_rows(table(spark, d, "combined_csv"))


def p4_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "combined_csv"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return disagreeing(p4_levels(spark, d))


def p4_words(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty of each word of the model on the scale of the levels, and how sharply it tells them apart."""
    model, _ = fitted(table(spark, d, "combined_csv"))
    return spark.createDataFrame(word_difficulties(model), "word string, difficulty double, discrimination double")


def p6_subjects(spark: SparkSession, d: str) -> DataFrame:
    return text_subjects(table(spark, d, "combined_csv"), table(spark, d, "topics_top_words_de"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dealt_with(text_subjects(table(spark, d, "combined_csv"), table(spark, d, "topics_top_words_de"), asked=F.col("topic").isNull()))


def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    return judged(Workspace(spark).save(text_statistics(table(spark, d, "combined_csv"))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_statistics(spark, d).where("not_prose").select("row_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of every piece of documents, for each row of packing_specs, in tokens of its own tokenizer."""
    specs, documents, out = table(spark, d, "packing_specs"), table(spark, d, "documents"), None
    for name in sorted(r[0] for r in specs.select("tokenizer").distinct().collect()):
        part = packed(token_counts(documents, path=tokenizer_path(name + ".json")), specs.where(F.col("tokenizer") == name))
        out = part if out is None else out.union(part)
    return packed(token_counts(documents.limit(0)), specs) if out is None else out


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return unlike_pairs(Workspace(spark).save(form_classes(table(spark, d, "documents"))))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return forms(table(spark, d, "documents"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens, type-token ratio and mean word length of every text."""
    stats = text_statistics(table(spark, d, "combined_csv"))
    return stats.select("row_id", F.col("word_count").cast("bigint").alias("word_count"), F.round("ttr_200", 6).alias("ttr_200"), F.round("mean_word_len", 6).alias("mean_word_len"))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """Rows, families in more than one split, and splits whose share of the rows is more than two points off."""
    rows = Workspace(spark).save(p5_splits(spark, d))
    torn = rows.groupBy("family").agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("torn_families"))
    total = rows.agg(F.count("*").alias("n_rows"))
    share = rows.groupBy("split").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    wanted = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    uneven = share.agg(F.count_if(F.abs(F.col("n") / F.col("n_rows") - wanted) > 0.02).alias("uneven_splits"))
    return total.crossJoin(torn).crossJoin(uneven)


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each spec: documents placed, containers that are overfull, documents split without need, and containers with gaps in their places."""
    places = Workspace(spark).save(p9_packing(spark, d))
    specs = table(spark, d, "packing_specs").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity").cast("bigint").alias("capacity"))
    bins = places.groupBy("spec_id", "container").agg(F.sum("size").alias("load"), F.max("place").alias("last"), F.count("*").alias("n")).join(F.broadcast(specs), "spec_id")
    of_bins = bins.groupBy("spec_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"), F.count_if(F.col("last") != F.col("n")).alias("gaps"))
    documents = places.groupBy("spec_id", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("pieces")).join(F.broadcast(specs), "spec_id")
    of_documents = documents.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("needless_splits"))
    return of_documents.join(of_bins, "spec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_groups, p3_found, p3_collapsed, p4_found, p4_levels, p4_words, p5_found, p5_splits, p5_checked, p6_found, p6_subjects, p7_found, p7_statistics, p7_counts, p8_ids, p9_packing, p9_checked, p10_found, p10_forms)}

_COMPONENTS = """
, two AS (SELECT u AS a, v AS b FROM links UNION ALL SELECT v, u FROM links),
walk(a, b) AS (SELECT a, b FROM two UNION SELECT w.a, t.b FROM walk w JOIN two t ON w.b = t.a)
SELECT least(a, min(b)) AS first_row_id, a AS row_id FROM walk GROUP BY a HAVING min(b) < a
"""

_SHINGLES = r"""t AS (SELECT row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM combined_csv WHERE text IS NOT NULL),
s AS (SELECT DISTINCT row_id, concat_ws(' ', ws[k], ws[k + 1], ws[k + 2]) AS g FROM t, unnest(range(1, len(ws) - 1)) r(k) WHERE len(ws) >= 10),
n AS (SELECT row_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS sig FROM s GROUP BY row_id),
b AS (SELECT x.row_id AS i, y.row_id AS j, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.row_id < y.row_id GROUP BY ALL),
alike AS (SELECT i, j FROM b JOIN n p ON p.row_id = i JOIN n q ON q.row_id = j WHERE c >= 0.6 * (p.n + q.n - c) - 1e-9)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_SHINGLES} SELECT i, j FROM alike",
    "p1_groups": f"""WITH RECURSIVE {_SHINGLES}, c AS (SELECT row_id, min(row_id) OVER (PARTITION BY sig) AS class_id FROM n),
two AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM (SELECT i, j FROM alike UNION ALL SELECT j, i FROM alike) JOIN c a ON a.row_id = i JOIN c b ON b.row_id = j WHERE a.class_id <> b.class_id),
walk(a, b) AS (SELECT a, b FROM two UNION SELECT w.a, t.b FROM walk w JOIN two t ON w.b = t.a), low AS (SELECT a, least(a, min(b)) AS low FROM walk GROUP BY a), deg AS (SELECT a, count(*) AS n_links FROM two GROUP BY a)
SELECT row_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(low, class_id) AS group_id FROM c LEFT JOIN deg ON deg.a = class_id LEFT JOIN low ON low.a = class_id""",
    "p5_checked": "SELECT count(*) AS n_rows, 0::BIGINT AS torn_families, 0::BIGINT AS uneven_splits FROM combined_csv",
    "p7_counts": f"""WITH k AS (SELECT row_id, CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN {WHITE_SPACE_TOKENS % "text"} END AS ts FROM combined_csv)
SELECT row_id, len(ts)::BIGINT AS word_count, round(CASE WHEN len(ts) >= 20 THEN len(list_distinct(list_transform(ts[1:200], lambda t: lower(t)))) / least(len(ts), 200) END, 6) AS ttr_200, round(list_sum(list_transform(ts, lambda t: length(t))) / len(ts), 6) AS mean_word_len FROM k""",
    "p9_checked": "SELECT spec_id::INTEGER AS spec_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS needless_splits, 0::BIGINT AS overfull, 0::BIGINT AS gaps FROM packing_specs",
    "p2_found": """WITH RECURSIVE links AS (
SELECT DISTINCT least(i, CAST(j AS BIGINT)) AS u, greatest(i, CAST(j AS BIGINT)) AS v FROM near_duplicates_de
WHERE similarity >= 0.85 AND i <> j AND i IN (SELECT row_id FROM combined_csv) AND j IN (SELECT row_id FROM combined_csv))"""
    + _COMPONENTS,
    "p3_found": r"""WITH RECURSIVE k AS (SELECT row_id, text, replace(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')), 'ß', 'ss') AS plain FROM combined_csv),
f AS (SELECT row_id, plain, CASE WHEN regexp_matches(text, '^[\s|;]*[\p{Z}\s]*\p{L}[\p{L}\p{N}]*([ \-_][\p{L}\p{N}]+){0,3}[\p{Z}\s]*:') THEN
  regexp_replace(text, '[\n\r|;]+([\p{Z}\s]*\p{L}[\p{L}\p{N}]*(?:[ \-_][\p{L}\p{N}]+){0,3}[\p{Z}\s]*:)', chr(1) || '\1', 'g') END AS cut FROM k WHERE plain <> ''),
g AS (SELECT row_id, plain, CASE WHEN contains(cut, chr(1)) THEN list_sort(list_filter(list_transform(string_split(cut, chr(1)),
  lambda p: replace(lower(regexp_replace(p, '[^\p{L}\p{N}]+', '', 'g')), 'ß', 'ss')), lambda p: p <> '')) END AS fields FROM f),
n AS (SELECT 'p' || plain AS v, row_id FROM g UNION ALL SELECT 'f' || array_to_string(fields, chr(2)), row_id FROM g WHERE len(fields) >= 2),
links AS (SELECT DISTINCT min(row_id) OVER (PARTITION BY v) AS u, row_id AS v FROM n)"""
    + _COMPONENTS,
    "p5_found": """WITH RECURSIVE keyed AS (
SELECT row_id, 1 AS kind, lower(trim(cv_group)) AS k FROM combined_csv UNION ALL SELECT row_id, 2, lower(trim(pair_id)) FROM combined_csv),
usable AS (SELECT row_id, min(row_id) OVER (PARTITION BY kind, k) AS low FROM keyed WHERE k IS NOT NULL AND k NOT IN ('', 'nan', 'na')),
links AS (SELECT DISTINCT low AS u, row_id AS v FROM usable WHERE low < row_id)"""
    + _COMPONENTS,
}
SQL["p2_groups"] = f"WITH first AS ({SQL['p2_found']}) SELECT row_id, 'cv_' || coalesce(first_row_id, row_id) AS cv_group FROM combined_csv LEFT JOIN first USING (row_id)"
SQL["p3_collapsed"] = f"WITH first AS ({SQL['p3_found']}) SELECT coalesce(first_row_id, row_id) AS row_id, count(*) AS n_copies FROM combined_csv LEFT JOIN first USING (row_id) GROUP BY 1"

"""Queries of sources, integrity rules and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwerk.functions import text as T
from textwerk.operators import clean as C, graph as G, integrity as Q
from textwerk.operators.durable import Workspace, table
from textwerk.plans.corpus import CLEAN, texts_of
from textwerk.plans.named import registrar
from textwerk.sources import readers, writers
from textwerk.streaming.cells import merged, running_cells

QUERIES, SQL, query = registrar()


@query("SELECT dataset, count(*) AS n FROM combined_csv WHERE cv_group IS NULL GROUP BY dataset")
def rows_without_group(spark, d):
    return Q.ungrouped(table(spark, d, "combined_csv")).select(F.col("subject").alias("dataset"), F.regexp_extract("detail", r"^(\d+)", 1).cast("bigint").alias("n"))


@query(f"""WITH {CLEAN}, a AS (SELECT dataset || '/' || cefr_level AS k, count(*)::DOUBLE AS n FROM texts GROUP BY 1), b AS (SELECT dataset || '/' || cefr_level AS k, sum(n)::DOUBLE AS n FROM descriptives_de WHERE cefr_level <> 'ALL' GROUP BY 1)
SELECT 'unequal' AS rule, coalesce(a.k, b.k) AS subject FROM a FULL JOIN b USING (k) WHERE a.n IS NULL OR b.n IS NULL OR abs(a.n - b.n) > 1e-12""")
def reconciled_descriptives(spark, d):
    """Corpora and levels whose number of clean texts differs from the recorded one."""
    a = texts_of(spark, d).groupBy(F.concat_ws("/", "dataset", "cefr_level").alias("k")).agg(F.count("*").cast("double").alias("n"))
    b = table(spark, d, "descriptives_de").where("cefr_level <> 'ALL'").groupBy(F.concat_ws("/", "dataset", "cefr_level").alias("k")).agg(F.sum("n").cast("double").alias("n"))
    return Q.unequal(a, b, "k", "n").select("rule", "subject")


@query("SELECT dataset AS measure, round(max(mean_word_len) - min(mean_word_len), 6) AS span FROM descriptives_de WHERE mean_word_len IS NOT NULL AND cefr_level <> 'ALL' GROUP BY dataset HAVING max(mean_word_len) - min(mean_word_len) > 0.5")
def drifting_ratios(spark, d):
    """Corpora whose mean word length differs by more than the tolerance between batches and levels."""
    found = Q.drift(table(spark, d, "descriptives_de").where("cefr_level <> 'ALL'"), "mean_word_len", 0.5, "dataset")
    return found.select(F.col("subject").alias("measure"), F.regexp_extract("detail", r"([0-9.]+)$", 1).cast("double").alias("span"))


@query("SELECT dataset_i, dataset_j, count(*) AS n FROM near_duplicates_de WHERE dataset_i = 'merlin_de' AND dataset_j = 'elg_cefr_de' OR dataset_i = 'elg_cefr_de' AND dataset_j = 'merlin_de' GROUP BY ALL")
def recorded_pairs_between(spark, d):
    """Recorded pairs of two corpora, in either order."""
    return C.pairs_between(table(spark, d, "near_duplicates_de"), "merlin_de", "elg_cefr_de").groupBy("dataset_i", "dataset_j").agg(F.count("*").alias("n"))


@query(f"""WITH {CLEAN}, e AS (SELECT dataset, count(*) AS n FROM texts GROUP BY 1), s AS (SELECT dataset, count(*) AS m FROM texts WHERE topic IS NOT NULL GROUP BY 1)
SELECT 'incomplete' AS rule, dataset AS subject, coalesce(m, 0) || ' of ' || n AS detail FROM e LEFT JOIN s USING (dataset) WHERE coalesce(m, 0) <> n""")
def incomplete_topics(spark, d):
    """Corpora in which not every clean text has a topic, by the rule for predictions."""
    rows = texts_of(spark, d)
    return Q.incomplete(rows.where("topic is not null").select("row_id", "dataset"), rows.groupBy("dataset").agg(F.count("*").alias("n")), "dataset")


@query("""WITH g AS (SELECT dataset, count(*) AS n FROM combined_csv WHERE cv_group IS NULL GROUP BY dataset), p AS (SELECT pair_id, count(DISTINCT cv_group) AS n FROM combined_csv WHERE pair_id IS NOT NULL AND cv_group IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cv_group) > 1),
b AS (SELECT DISTINCT i, j::BIGINT AS j FROM near_duplicates_de n JOIN combined_csv a ON a.row_id = n.i JOIN combined_csv b ON b.row_id = n.j WHERE similarity >= 0.85 AND a.cv_group <> b.cv_group)
SELECT 'ungrouped' AS rule, dataset AS subject, n || ' rows' AS detail FROM g UNION ALL SELECT 'split family', pair_id, n || ' groups' FROM p UNION ALL SELECT 'broken link', i || '-' || j, 'different groups' FROM b""")
def violations(spark, d):
    """All violations of the rules on groups: rows without one, families in several, and linked rows in different ones."""
    rows, pairs = table(spark, d, "combined_csv"), table(spark, d, "near_duplicates_de").where("similarity >= 0.85")
    split = G.split_families(rows).select(F.lit("split family").alias("rule"), F.col("key").alias("subject"), F.format_string("%d groups", "groups").alias("detail"))
    broken = G.broken_links(rows, pairs).select(F.lit("broken link").alias("rule"), F.concat_ws("-", "i", "j").alias("subject"), F.lit("different groups").alias("detail"))
    return Q.ungrouped(rows).union(split).union(broken)


@query("SELECT vec_id AS id, len(embedding)::INTEGER AS width, true AS finite, list_min(embedding) >= 0 AS usable FROM embeddings")
def vector_conditions(spark, d):
    """Width of each vector, whether its numbers are finite, and whether it could be used as weights, that is without negative ones."""
    v = readers.vectors(spark, f"{d}/embeddings.parquet")
    return v.select("id", F.size("vector").alias("width"), Q.finite(F.transform("vector", F.abs)).alias("finite"), Q.finite(F.col("vector")).alias("usable"))


@query("SELECT batch_id, dataset, cefr_level, tokens_min::DOUBLE AS low, tokens_max::DOUBLE AS high FROM descriptives_de")
def parsed_ranges(spark, d):
    """Ranges written as text and read again."""
    text = F.format_string("%s [%d, %d]", "dataset", "tokens_min", "tokens_max")
    return table(spark, d, "descriptives_de").withColumn("_t", text).select("batch_id", "dataset", "cefr_level", T.interval_bound(F.col("_t"), 1).alias("low"), T.interval_bound(F.col("_t"), 2).alias("high"))


def _levels(rows):
    return rows.groupBy("cefr_level").agg(F.count("*").alias("n"))


@query("SELECT cefr_level, count(*) AS n FROM documents GROUP BY cefr_level")
def json_round_trip(spark, d):
    """Documents written as records, a line each, and read again from a folder of corpora."""
    base = Workspace(spark).path("corpora")
    writers.json_lines(table(spark, d, "documents").select("title", "lang", "cefr_level", "text"), base + "/documents.jsonl")
    return _levels(readers.json_records(spark, base))


@query("SELECT nullif(cefr_level, '') AS cefr_level, count(*) AS n FROM documents GROUP BY 1")
def csv_round_trip(spark, d):
    """Documents written as one CSV file, texts with line breaks and quotes among them, and read again."""
    path = Workspace(spark).path("documents.csv")
    rows = table(spark, d, "documents").select("doc_id", "cefr_level", "text")
    writers.csv_report(rows, path)
    return _levels(readers.csv_table(spark, path, rows.schema))


@query("SELECT 'a' AS dataset, lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'b', 'de', count(*) FROM combined_csv")
def united_corpora(spark, d):
    """Two corpora with different columns, united by name, and a third that is absent."""
    base = Workspace(spark)
    table(spark, d, "documents").select("title", "lang", "text").write.parquet(base.path("a"))
    table(spark, d, "combined_csv").select("text", "cefr_level", F.lit("de").alias("lang")).write.parquet(base.path("b"))
    return readers.parquet_corpora(spark, {n: base.path(n) for n in "abc"}).groupBy("dataset", "lang").agg(F.count("*").alias("n"))


@query("SELECT cefr_level AS x, category AS y, count(*) AS n FROM combined_csv WHERE cefr_level IS NOT NULL AND category IS NOT NULL GROUP BY ALL")
def streamed_cells(spark, d):
    """Cells of raw level and category, from a stream over the table; each batch replaces the written cells."""
    source, base = table(spark, d, "combined_csv"), Workspace(spark)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/combined_csv.parquet*")
    cells = running_cells(stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")), "cefr_level", "category", "loaded_at", "3650 days")
    write = lambda df, n: df.write.mode("overwrite").parquet(base.path("cells"))
    run = cells.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", base.path("state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return merged(spark.read.parquet(base.path("cells")))

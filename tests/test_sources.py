"""Readers, writers and integrity rules, with defined results for absent and odd input."""

import json
import math

import pytest
from pyspark.sql import functions as F

from textwerk.operators import association, clean, durable, graph, integrity, metrics, similarity, topics
from textwerk.functions import text as T
from textwerk.sources import readers, writers

ODD = [("a", 'He said "no",\nthen "yes"'), ("b", " blanks "), ("c", None), ("d", ""), ("ü", "ß|x")]


def test_csv_keeps_texts(spark, tmp_path):
    df = spark.createDataFrame(ODD, "k string, text string")
    writers.csv_report(df, str(tmp_path / "r.csv"))
    assert len(list((tmp_path / "r.csv").glob("part-*"))) == 1
    assert sorted(map(tuple, readers.csv_table(spark, str(tmp_path / "r.csv"), df.schema).collect())) == sorted((k, x or None) for k, x in ODD)
    assert readers.csv_table(spark, str(tmp_path / "none.csv"), df.schema).count() == 0


def test_records(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"text": "x", "cefr_level": "A1"}\n\n{"text": "ä"}\n', encoding="utf-8")
    (tmp_path / "two.json").write_text(json.dumps([{"text": "z", "lang": "de"}]), encoding="utf-8")
    got = {(r.dataset, r.text, r.cefr_level, r.lang) for r in readers.json_records(spark, str(tmp_path)).collect()}
    assert got == {("one", "x", "A1", None), ("one", "ä", None, None), ("two", "z", None, "de")}
    assert readers.json_records(spark, str(tmp_path / "none")).count() == 0
    writers.json_lines(spark.createDataFrame([("ä",)], "text string"), str(tmp_path / "out"))
    assert "ä" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))


def test_one_text_a_file(spark, tmp_path):
    (tmp_path / "doc_12_3_A2.simpde").write_text("Erste Zeile.\n\n  Zweite Zeile.  \n", encoding="utf-8")
    (tmp_path / "doc_12_4_B1.simpde").write_text("Nur eine.", encoding="utf-8")
    got = {tuple(r) for r in readers.text_files(spark, str(tmp_path / "*.simpde")).select("pair_id", "cefr_level", "text").collect()}
    assert got == {("12_3", "A2", "Erste Zeile. Zweite Zeile."), ("12_4", "B1", "Nur eine.")}
    assert readers.text_files(spark, str(tmp_path / "*.none")).count() == 0


def test_corpora_documents_and_vectors(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, text string").write.parquet(str(tmp_path / "p1"))
    spark.createDataFrame([("y",)], "text string").write.parquet(str(tmp_path / "p2"))
    got = readers.parquet_corpora(spark, {"p1": str(tmp_path / "p1"), "p2": str(tmp_path / "p2"), "none": str(tmp_path / "none")})
    assert {(r.a, r.text, r.dataset) for r in got.collect()} == {(1, "x", "p1"), (None, "y", "p2")}
    assert readers.parquet_corpora(spark, {"none": str(tmp_path / "none")}).count() == 0
    writers.json_report({"x": [1.5, math.nan, math.inf], "y": {"z": None}}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"x": [1.5, None, None], "y": {"z": None}}
    assert readers.json_document(spark, str(tmp_path / "d.json")).first()["x"][0] == 1.5
    assert readers.json_document(spark, str(tmp_path / "none.json")).count() == 0
    vectors = spark.createDataFrame([(1, [0.5, -1.0]), (2, None)], "id bigint, vector array<double>")
    writers.vector_table(vectors, str(tmp_path / "v"))
    assert sorted(map(tuple, readers.vectors(spark, str(tmp_path / "v"), "id", "vector").collect())) == [(1, [0.5, -1.0]), (2, None)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.12345, None)], "k string, x double, y string")
    assert writers.markdown_table(df).splitlines()[2] == "| a\\|b | 0.123 |  |"
    with pytest.raises(ValueError):
        writers.markdown_table(spark.range(5), limit=4)
    assert writers.text_report(["one", "two"], str(tmp_path / "r.txt")) == "one\ntwo\n" == (tmp_path / "r.txt").read_text()


def test_stop_words(spark):
    words = readers.stop_words(("german", "english"))
    assert words == sorted(set(words)) and {"und", "the", "don't", "don"} <= set(words)
    df = spark.createDataFrame([(i, "und der Baum und das Tor") for i in range(4)], "row_id bigint, text string")
    assert {r.term for r in similarity.word_weights(df, stop=words).collect()} == {"baum", "tor"}


def test_stale_and_fresh_results(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string"), str(tmp_path / "state.json")
    assert integrity.stale(path, {"source": df}) == "no provenance"
    writers.provenance(path, {"source": df}, k=10)
    assert integrity.stale(path, {"source": df.orderBy(F.desc("id")).repartition(3)}) is None
    assert integrity.stale(path, {"source": df.union(df)}) == "source has changed"


def test_incomplete_predictions(spark):
    found = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (1, "b")], "row_id bigint, features string")
    wanted = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "features string, n bigint")
    assert {(r.subject, r.detail) for r in integrity.incomplete(found, wanted).collect()} == {("b", "1 of 2"), ("c", "0 of 2")}
    nothing = integrity.incomplete(found.where("features = 'a'"), wanted.where("features = 'a'"))
    assert integrity.manifest(spark, {"predictions": wanted}, nothing)["predictions"][0] == {"features": "a", "n": 2}
    with pytest.raises(ValueError):
        integrity.manifest(spark, {}, integrity.incomplete(found, wanted))


def test_conditions(spark):
    rows = [([0.0, 1.0], True), ([], True), ([math.nan], False), ([math.inf], False), ([-1e-9], False), ([None], False), (None, False)]
    df = spark.createDataFrame(rows, "w array<double>, good boolean")
    assert all(r.good == r.found for r in df.withColumn("found", integrity.finite(F.col("w"))).collect())
    assert integrity.missing_columns(df, ["w", "x"], "t") == ["t.x"]
    assert spark.range(1).select(metrics.calibration(F.lit(0.5), 0.25, 0.75).alias("x"), metrics.calibration(F.lit(0.5), 1.0, 1.0).alias("y")).first()[:] == (0.5, None)
    texts = spark.createDataFrame([("V = [0.1, -2]",), ("none",)], "t string")
    assert [tuple(r) for r in texts.select(T.interval_bound(F.col("t"), 1), T.interval_bound(F.col("t"), 2)).collect()] == [(0.1, -2.0), (None, None)]
    assert [r[0] for r in texts.select(T.ellipsis(F.lit("eins zwei drei"), 10)).collect()] == ["eins zwei…"] * 2


def test_columns_and_subsets(spark):
    df = spark.createDataFrame([(1, "g", None, "x"), (2, None, "p", "y")], "row_id bigint, cv_group string, pair_id string, dataset string")
    with pytest.raises(ValueError):
        graph.group_column(df)
    assert graph.group_column(df.fillna("q", ["pair_id"])) == "pair_id"
    with pytest.raises(ValueError, match="'x', 'y'"):
        clean.corpus_subset(df, "z")
    assert clean.corpus_subset(df, "x").count() == 1
    assert [r.pair_id for r in clean.ensured_pair_ids(df.drop("pair_id")).orderBy("row_id").collect()] == ["x__1", "y__2"]
    assert [r.pair_id for r in clean.ensured_pair_ids(df).orderBy("row_id").collect()] == [None, "p"]


def test_degenerate_tables_have_no_v(spark):
    cells = spark.createDataFrame([("a", "x", 3), ("a", "y", 4)], "x string, y string, n bigint")
    r = association.chi_square(cells).first()
    assert (r.v, r.v_uncorrected, r.dof) == (None, None, 0)


def test_nearest_in_every_other_corpus(spark):
    import random

    r = random.Random(2)
    rows = []
    for i in range(60):
        raw = {f"t{r.randrange(25)}": r.random() for _ in range(6)}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        rows += [(i, "abc"[i % 3], t, x / norm) for t, x in raw.items()]
    by = {}
    for i, d, t, x in rows:
        by.setdefault((i, d), {})[t] = x
    want = {}
    for (i, d), v in by.items():
        for other in "abc":
            scores = [(-round(s, 9), j) for (j, e), u in by.items() if e == other != d and (s := sum(x * u.get(t, 0) for t, x in v.items())) > 0]
            if scores:
                want[i, other] = min(scores)[1]
    got = similarity.nearest_across(spark.createDataFrame(rows, "id bigint, dataset string, term string, w double")).collect()
    assert {(x.i, x.dataset): x.j for x in got} == want and len(got) == len(want)


def test_keyword_weights_and_hashed_vectors(spark):
    terms = spark.createDataFrame([(t,) for t in "abcdef"], "term string")
    words = topics.hashed_vectors(terms, 1)
    v = {r.term: r.vector for r in words.collect()}
    assert all(len(x) == 64 and set(x) <= {1.0, -1.0} for x in v.values()) and len({tuple(x) for x in v.values()}) == 6
    weights = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.1), (2, "c", 1.0)], "id bigint, term string, w double")
    got = {(r.id, r.term): r.w for r in topics.keyword_weights(weights, terms, topics.text_vectors(weights, words), words, 1).collect()}
    assert set(got) == {(1, "a"), (2, "c")} and got[2, "c"] == pytest.approx(1.0)


def test_sweep_deletes_written_tables(spark):
    ws = durable.Workspace(spark)
    ws.save(spark.range(3))
    path = ws._path(ws.base)
    assert ws._fs.exists(path)
    durable.sweep()
    assert not ws._fs.exists(path)

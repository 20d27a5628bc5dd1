"""Links, copies, families and near duplicates against brute force, with defined results for odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textwerk.llm import components, families, near, writings
from textwerk.operators import skew
from textwerk.operators.durable import Workspace


def brute(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {a: find(a) for a in parent}


SHUFFLED = random.Random(1).sample(range(500), 90)
CASES = {
    "empty": [],
    "nulls and loops": [(None, 1), (2, None), (3, 3)],
    "chain": [(i, i + 1) for i in range(60)],
    "shuffled chain": list(zip(SHUFFLED, SHUFFLED[1:])),
    "star and pairs": [(7, i) for i in range(20, 60)] + [(100, 101), (101, 100), (100, 101), (200, 201)],
    "random": [(random.Random(k).randrange(300), random.Random(k + 1000).randrange(300)) for k in range(260)],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    edges = CASES[case]
    df = spark.createDataFrame(edges, "i bigint, j bigint").withColumn("vertex", F.lit("x")).withColumn("label", F.lit(1))
    want = brute(edges)
    assert {r.vertex: r.label for r in components.peeled_components(df).collect()} == want
    assert {r.vertex: r.label for r in components.seeded_components(df).collect()} == want


def test_peeling_stops_early_without_change(spark):
    edges = CASES["chain"] + CASES["random"]
    df = spark.createDataFrame(edges, "i bigint, j bigint")
    assert {r.vertex: r.label for r in components.peeled_components(df, bfs_rounds=2).collect()} == brute(edges)


def test_families_and_splits(spark):
    rows = [(1, " CV_1 ", None, "A1"), (2, "cv_1", "P", "A1+"), (3, None, "p ", "B1"), (4, "nan", "NA", None), (5, " ", "", "A1"), (6, "cv_9", None, "B1"), (None, "cv_9", None, "B1")]
    df = spark.createDataFrame(rows, "row_id bigint, cv_group string, pair_id string, cefr_level string").withColumn("family", F.lit("x"))
    assert {(r.row_id, r.family) for r in families.families(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert families.families(df.limit(0)).count() == 0
    many = [(i, f"g{i // 4}" if i % 5 else None, f"p{i // 7}" if i % 3 == 0 else "nan", ["A1", "B1", None][i % 3]) for i in range(3000)]
    got = families.split_rows(spark.createDataFrame(many, "row_id bigint, cv_group string, pair_id string, cefr_level string")).collect()
    assert len(got) == 3000 and len({(r.family, r.split) for r in got}) == len({r.family for r in got})
    n = sum(r.split == "train" for r in got)
    assert 0.76 < n / 3000 < 0.84


def test_writings(spark):
    rows = [(1, "Hallo, Welt!"), (2, "HALLO WELT"), (3, "hallo-welt"), (4, "Straße 5"), (5, "STRASSE5"), (6, "Ort: Ulm | Grund: Bad"), (7, "grund: bad\nort: ulm."), (8, ""), (9, None), (10, "..."), (11, "..."), (12, "Ort: Ulm Grund: Bad"), (13, "x" * 300_000), (14, "X" * 300_000 + "!")]
    df = spark.createDataFrame(rows, "row_id bigint, text string").withColumns({"key": F.lit(1), "first": F.lit(2), "n": F.lit(3)})
    want = {(1, 2), (1, 3), (4, 5), (6, 7), (6, 12), (13, 14)}
    assert {(r.first_row_id, r.row_id) for r in writings.same_writing(df).collect()} == want
    sizes = {r.row_id: r.n_copies for r in writings.collapsed(df).collect()}
    assert sizes == {1: 3, 4: 2, 6: 3, 8: 1, 9: 1, 10: 1, 11: 1, 13: 2}
    assert writings.same_writing(df.limit(0)).count() == 0


def test_hot_keys_are_salted(spark):
    df = spark.range(1, 4001).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Same text here").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    hot, _ = writings.copies_by_key(writings.keyed_rows(df), "plain", "row_id")
    assert [(r["first"], r["n"]) for r in hot.collect()] == [(3, 1333)]
    assert writings.same_writing(df).agg(F.count("*"), F.min("first_row_id"), F.max("first_row_id")).first()[:] == (1332, 3, 3)


def brute_pairs(rows, t, size, least):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if len(words) >= least and len(words) >= size:
            sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("t,size", [(0.6, 3), (0.8, 5)])
def test_near_pairs(spark, t, size, monkeypatch):
    r = random.Random(5)
    words = [f"wort{k}" for k in range(60)]
    base = [[r.choice(words) for _ in range(r.randrange(8, 60))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(5):
            c = list(b)
            for _ in range(r.randrange(0, 5)):
                c[r.randrange(len(c))] = r.choice(words)
            rows.append(" ".join(c))
    rows += [rows[0]] * 6 + ["", None, "kurz", " ".join(words * 300)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "row_id bigint, text string").withColumns({"key": F.lit(1), "set": F.lit(2), "n": F.lit(3)})
    want = brute_pairs(rows, t, size, 10)
    got = near.near_pairs(*near.near_classes(df, threshold=t, size=size)).collect()
    assert {(x.i, x.j) for x in got} == want and len(got) == len(want) > 15


def test_hot_shingles_are_dealt_to_blocks(spark, monkeypatch):
    """The same pairs result when shingles are hot, by their exact counts, and when the slots of the sketch are so crowded that all may be."""
    r = random.Random(9)
    same = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(same + [f"e{r.randrange(9)}" for _ in range(6)])) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, text string").repartition(4)
    want = brute_pairs(rows, 0.6, 3, 10)
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(skew, "BLOCK", 4)
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    monkeypatch.setattr(near, "REMEMBERED", 5)
    for slots in (1 << 20, 8):
        monkeypatch.setattr(near, "SLOTS", slots)
        monkeypatch.setattr(near, "MOST_SLOTS", slots)
        assert {(x.i, x.j) for x in near.near_pairs(*near.near_classes(df, threshold=0.6, size=3)).collect()} == want
    # the texts share shingles that are in more prefixes than two blocks hold
    ws = Workspace(spark)
    sets = ws.save(near.shingled(df, "text", "row_id", 3, 10))
    rows = near.prefixes(sets, 0.6, spark.sparkContext.broadcast(near.shingle_counts(sets)), 3, 3)
    assert near.in_cells(ws, rows).where("cell > 0").count() > 0


def test_no_near_pairs(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "row_id bigint, text string")
    members, links = near.near_classes(df)
    assert members.count() == 0 and links.count() == 0 and near.near_pairs(members, links).count() == 0
    members, links = near.near_classes(df.limit(0))
    assert members.count() == 0 and links.count() == 0


def test_pruning_keeps_true_pairs():
    limits = near.least_matches(0.6, near.STEP, 1 / 256, near.HASHES)
    assert list(limits) == sorted(limits) and limits[-1] < 0.6 * near.HASHES


def test_writings_are_closed(spark):
    """A text that is the same as a third one is in its class."""
    rows = [(1, "Name Anna Ort Berlin"), (2, "Name: Anna\nOrt: Berlin"), (3, "Ort: Berlin\nName: Anna"), (4, "ort berlin name anna"), (5, "Ort: Ulm")]
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    assert {(r.first_row_id, r.row_id) for r in writings.same_writing(df).collect()} == {(1, 2), (1, 3), (1, 4)}
    assert {r.row_id: r.n_copies for r in writings.collapsed(df).collect()} == {1: 4, 5: 1}


@pytest.mark.parametrize("centre", [0, 5000])
def test_a_vertex_with_half_of_all_links(spark, monkeypatch, centre):
    """The hub is handled as heavy, with the smallest and with the largest id."""
    for module in (components, skew):
        monkeypatch.setattr(module, "LEAST_ROWS", 50)
    r = random.Random(3)
    edges = [(centre, k) for k in range(1, 400)] + [(a, a + 1 + r.randrange(3)) for a in range(1000, 1400)]
    df = spark.createDataFrame(edges, "i bigint, j bigint")
    assert components.hubs(components.undirected(df, "i", "j"), 1000) == [centre]
    want = brute(edges)
    for method in (components.seeded_components, lambda d: components.peeled_components(d, bfs_rounds=1)):
        assert {x.vertex: x.label for x in method(df).collect()} == want

"""Tokens, packing, forms, prose, levels and subjects."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwerk.llm import levels, lookalikes, packing, prose, subjects, tokens

ODD = ["", None, " ", "a", "don't we'll", "  two\n\n spaces\t", "Äpfel größer ½ ① 日本語 слово", "x" * 5000, "ab" * 3000, "<|endoftext|>", "👩‍🏫 ❤️", "a\x00b\x1cc\x85d", "12345 67", "Ｗｉｄｅ", "​"]


def tokenizers():
    return pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")


def test_ids_equal_the_library(spark):
    p, t = tokenizers()
    reference = t.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string").withColumn("ids", F.lit("x"))
    got = {r.doc_id: r.ids for r in tokens.encoded(df).collect()}
    assert got == {i: reference.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(ODD)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encoded(df.limit(0)).count() == 0


def test_verified_speculation_equals_exact_merging():
    tokenizers()
    e = tokens.Encoder(tokens.read_vocabulary(tokens.tokenizer_path()))
    r = random.Random(2)
    words = ["".join(r.choice("aeinrst ßüöxyz-.") for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    assert e.learn(words) == {w: e.merged(w.encode()) for w in words}
    long = [e.byte[b] for b in ("abcdefgh" * 60).encode()]
    assert e.merged_long(list(long)) == e.merged(("abcdefgh" * 60).encode())


def test_packing(spark):
    r = random.Random(4)
    counts = [(i, r.choice([0, 1, 5, 30, 64, 65, 128, 200, r.randrange(1, 70)])) for i in range(900)] + [(900, None)]
    specs = spark.createDataFrame([(1, 64), (2, 1000)], "spec_id int, capacity int")
    df = spark.createDataFrame(counts, "doc_id bigint, n_tokens int").withColumn("bin", F.lit(0))
    got = packing.packed(df, specs).collect()
    for spec, capacity in ((1, 64), (2, 1000)):
        mine = [x for x in got if x.spec_id == spec]
        by_doc, by_bin = {}, {}
        for x in mine:
            by_doc.setdefault(x.doc_id, []).append(x)
            by_bin.setdefault(x.container, []).append(x)
        assert set(by_doc) == {i for i, _ in counts}
        for i, n in counts:
            pieces = sorted(by_doc[i], key=lambda x: x.piece)
            assert sum(x.size for x in pieces) == (n or 0)
            assert len(pieces) == max(1, -(-(n or 0) // capacity))
            assert [x.start for x in pieces] == [k * capacity for k in range(len(pieces))]
        assert max(sum(x.size for x in b) for b in by_bin.values()) <= capacity
        assert all(sorted(x.place for x in b) == list(range(1, len(b) + 1)) for b in by_bin.values())
        assert len(by_bin) <= 1.03 * sum(n or 0 for _, n in counts) / capacity + 1
    assert packing.packed(df.limit(0), specs).count() == 0


def test_generations_beat_best_fit():
    """Items of a quarter to half of the capacity, three a full bin: best fit leaves room that crossover and replacement fill."""
    r = np.random.default_rng(3)
    triples = [(a, b, 1000 - a - b) for a, b in zip(r.integers(260, 380, 120).tolist(), r.integers(255, 370, 120).tolist())]
    sizes = r.permutation(np.array([x for t in triples for x in t], np.int64))
    best_fit = packing.score_of(sizes, packing.fresh(sizes, 1000, 0.0, r), 1000)[0]
    population = [packing.fresh(sizes, 1000, 0.03 * k, r) for k in range(packing.POPULATION)]
    for _ in range(packing.EPOCHS):
        population = packing.evolve(sizes, 1000, population, r)
    best = population[0]
    assert max(np.bincount(best, weights=sizes)) <= 1000 and len(best) == len(sizes)
    assert packing.score_of(sizes, best, 1000)[0] < best_fit - 1


SAME = [("Sandtal ist schön", "Ѕаndtаl іst schön"), ("Über", "Über"), ("ﬁn", "fin"), ("Ａｂｃ", "Abc"), ("a b", "a b"), ("c d", "c d"), ("zu­sammen", "zusammen"), ("e‑mail", "e-mail"), ("x​y", "xy"), ("νon", "von"), ("ρarιs", "paris"), ("հօnig", "honig"), ("ᎪᏴer", "ABer"), ("g\r\nh", "g\nh")]
UNLIKE = [("Haus", "haus"), ("schön", "schon"), ("a b", "a  b"), ("1", "l"), ("слово", "слова"), ("👩‍🏫", "👩🏫")]


def test_forms():
    reader = lookalikes.Reader({"^с": 50, "сл": 50, "ло": 50, "ов": 50, "во": 50, "^S": 90, "Sa": 90})
    for a, b in SAME:
        assert reader.form(a) == reader.form(b), (a, b)
    for a, b in UNLIKE:
        assert reader.form(a) != reader.form(b), (a, b)
    assert reader.form("слово") == "слово" and reader.form("Ѕаndtаl") == "Sandtal" and reader.form("\u200b \u2060") == ""


def test_form_pairs(spark):
    texts = [x for pair in SAME for x in pair] + ["", None, "\u200b", "Sandtal ist schön"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"form": F.lit(1), "raw": F.lit(1)})
    got = {(r.doc_id_a, r.doc_id_b) for r in lookalikes.unlike_pairs(lookalikes.form_classes(df)).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(len(SAME))} | {(1, len(texts) - 1)}
    assert lookalikes.forms(df).count() == len(texts)
    assert lookalikes.unlike_pairs(lookalikes.form_classes(df.limit(0))).count() == 0


def corpus(spark, n=240):
    """Sentences of six levels and three subjects, with lists and odd rows."""
    r = random.Random(6)
    nouns = {0: ["tore", "bälle", "siege", "pokale"], 1: ["züge", "hotels", "koffer", "inseln"], 2: ["filme", "lieder", "museen", "romane"]}
    frames = ["das sind {}", "wir mögen die {} und die {}", "ich möchte {} sehen weil die {} schön sind", "obwohl viele die {} holen bleiben die {} ruhig", "zwar haben fachleute die {} bemängelt doch fehlen die {}", "ungeachtet der {} dürfte sich die bereitschaft erst einstellen wenn die {} entstehen"]
    rows = []
    for i in range(n):
        level, subject = i % 6, i % 3
        parts = [frames[level].format(*(r.choice(nouns[subject]).capitalize() for _ in range(2))) for _ in range(14)]
        parts = [p[0].upper() + p[1:] for p in parts]
        rows.append((i, ". ".join(parts) + ".", levels.LEVELS[level], subject))
    rows[6] = (6, rows[5][1], "A1", 2)  # reads like C2
    rows += [(n, "\n".join(f"- Tore Ulm {k}" for k in range(30)), "A1", 0), (n + 1, None, "A1", None), (n + 2, "", None, None), (n + 3, "???", "B1", 1), (n + 4, rows[0][1], "A1", 0)]
    return spark.createDataFrame(rows, "row_id bigint, text string, cefr_level string, topic int").withColumns({"lang": F.lit("x"), "word": F.lit(1)})


def test_prose(spark):
    rows = corpus(spark)
    got = {r.row_id: r for r in prose.judged(prose.text_statistics(rows)).collect()}
    assert len(got) == rows.count() and {i for i, r in got.items() if r.not_prose} == {240}
    assert got[241].word_count is None and got[243].word_count is None and got[0].word_count > 20 and got[0].not_prose is False
    assert prose.judged(prose.text_statistics(rows.limit(0))).count() == 0


def test_the_flag_follows_from_robust_deviations(spark):
    """Lists are in the lower tail of their language; a third of junk in the table does not hide it."""
    rows = corpus(spark).select("row_id", "text").union(spark.range(1000, 1100).select("id", F.concat(F.lit("Ulm Bonn Kiel 17\nKöln Jena "), "id", F.lit("\nTrier Gera 5"))))
    got = {r.row_id for r in prose.judged(prose.text_statistics(rows)).where("not_prose").collect()}
    assert got == {240} | set(range(1000, 1100))


def test_sketches_merge_in_bounded_size(spark):
    df = spark.range(0, 60_000, 1, 16).select(F.lit("de").alias("lang"), (F.col("id") / 60_000).alias("x"), F.lit(None).cast("double").alias("y"))
    found = prose.sketches(df, ("x", "y"))
    points = found["de", "x"]
    assert set(found) == {("de", "x")} and len(points) == prose.POINTS
    assert max(abs(p - k / (prose.POINTS - 1)) for k, p in enumerate(points)) < 0.02


def test_levels(spark):
    rows = corpus(spark)
    placed = levels.reading_levels(rows)
    assert [r.row_id for r in levels.disagreeing(placed).collect()] == [6]
    near = [abs(r.reading - r.label_rank) < 1 for r in placed.where("reading is not null and row_id <> 6").collect()]
    assert sum(near) / len(near) > 0.95
    assert levels.reading_levels(rows.limit(0)).count() == 0
    assert levels.reading_levels(rows.where("text is null")).first()["reading"] is None
    model, _ = levels.fitted(rows)
    difficulty = {w: d for w, d, _ in levels.word_difficulties(model)}
    assert difficulty["sind"] < difficulty["obwohl"] < difficulty["ungeachtet"]


def test_short_texts_are_placed(spark):
    rows = corpus(spark).select("row_id", "text", "cefr_level").union(spark.createDataFrame([(900, "Ungeachtet der Tore dürfte sich die Bereitschaft erst einstellen.", None)], "row_id bigint, text string, cefr_level string"))
    got = {r.row_id: r for r in levels.reading_levels(rows).collect()}
    assert got[900].n_words == 9 and got[900].reading > 3 and got[241].reading is None


def test_subjects(spark):
    known = spark.createDataFrame([(0, "tore, bälle"), (1, "züge, hotels"), (2, "filme, lieder")], "topic int, top_words string")
    rows = corpus(spark)
    found = subjects.dealt_with(subjects.text_subjects(rows, known)).collect()
    want = {(r.row_id, r.topic) for r in rows.where("row_id < 240").collect()}
    hits = {(r.row_id, r.topic) for r in found}
    assert len(hits & want) > 0.95 * len(want) and len(hits & want) > 0.95 * len({h for h in hits if h[0] < 240}) and not {h for h in hits if h[0] in (240, 241, 242, 243)}
    assert subjects.text_subjects(rows.limit(0), known).count() == 0


def test_every_text_takes_part_in_the_propagation(spark):
    """A word that occurs ten times in all of many texts is verified."""
    known = spark.createDataFrame([(0, "tore, bälle"), (1, "züge, hotels")], "topic int, top_words string")
    usual = ["Wir sehen das heute und morgen nicht mehr so gern.", "Das ist für die anderen auch so, und wir sehen es nicht.", "Heute ist das so und morgen auch, die anderen sehen es."]
    texts = [usual[i % 3] for i in range(60_000)]
    for k in range(10):
        texts[k * 5_000 + 17] = "Wir sehen die Tore und die Kranzel heute. " + usual[k % 3]
    texts.append(" ".join(["Wir sehen die Kranzel heute und morgen auch so gern."] * 4))
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    assert [(r.row_id, r.topic) for r in subjects.dealt_with(subjects.text_subjects(rows, known, asked=F.col("row_id") == 60_000)).collect()] == [(60_000, 0)]


def test_patterns_run_only_where_words_have_other_characters(monkeypatch):
    from textwerk.llm import prose, subjects

    texts = ["Der Hund, die Katze. Das\u00a0Haus_tür - x-y\nzwei  ²³ ½ _ __ a_b", "", "a", " , ", "e\u0301a,b|c. . d", "Ωmega १२ 中文,中 文\u2028z"] + [f"a{chr(c)}b {chr(c)}c" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    marked = lambda t: " ".join(t.split()).replace(". ", "\n").lower() + " "
    assert all(prose.different_words(t) == set(prose.WORD.findall(t)) for t in texts)
    assert all(subjects.words_and_ends(marked(t)) == subjects.WORD_OR_END.findall(marked(t)) for t in texts)
    seen = []

    class Spy:
        findall = staticmethod(lambda t: seen.append(t) or [])

    monkeypatch.setattr(prose, "WORD", Spy), monkeypatch.setattr(subjects, "WORD_OR_END", Spy)
    assert prose.different_words("der Hund") == {"der", "Hund"} and subjects.words_and_ends("der hund\ndie katze ") == ["der", "hund", "\n", "die", "katze"]
    assert not any(seen)

"""Subjects of texts by label propagation over a graph of passages.

A text may deal with several subjects, so that its sentences (passages) are the vertices, each tied to its text. Two passages are alike if they share
a feature, a word that passed verification; features stand between the passages they link, like pages that many others link to, which keeps the
graph linear in the number of passages. Passages with the same features are one vertex with a number of members.

1. *Verification.* All passages with a seed word are read once: a word of which many such passages have no common subject cannot tell
   subjects apart, and its links are removed. Words in too few passages to be verified have no links either.
2. *Propagation.* Vertices, links and labels (feature, subject, weight) are tables, and a round is a sequence of joins and aggregations: a
   passage sums the labels of its features; each of its features then hears what the passage says without it, so that a link never confirms itself. A
   feature takes a subject if it was heard often enough and one subject, or two or three together, have most of it. Labels are shares, that is normalised.
   Seeds stay clamped unless the passages show that a seed word belongs to another subject or to several.
3. *Texts.* A passage has the subject that leads among its features; a text has the subjects of its passages, with their shares. A passage that has only
   features of several subjects is read by the rest of its text.

The passages of all texts take part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textwerk.llm.prose import LINE, Line, common_of, language, least_of, line_ratios, word_counts
from textwerk.operators.durable import Workspace
from textwerk.operators.skew import HEAVIEST, LEAST_ROWS, heavy_keys, split_join

#: Rounds of the propagation at most; it ends when no label changes.
ROUNDS = 4
#: Counts of words and subjects, or vertices, that a task holds before it hands them on.
HELD = 200_000
#: A word is verified with so many passages, and this share of all texts at least (so that there can be no more features than different words a
#: text / ``LEAST_SHARE``), if this share of those with a subject is in one; or with ``MIXED_SUPPORT`` passages if two or
#: three subjects with a share of ``PART`` each have ``PURITY`` of them together.
SUPPORT, LEAST_SHARE, PURITY, PART, MIXED_SUPPORT = 8, 1e-5, 0.9, 0.08, 40
#: A subject belongs to a text if this share of its sentences deals with it; texts need so many words.
SHARE, LEAST_WORDS = 0.25, 30
#: What ends a sentence in a line with single blanks.
SENTENCE_ENDS = (". ", "! ", "? ", "… ", "; ", "|", " - ", " – ")
WORD_OR_END = re.compile(r"[^\W_]+|\n")
#: A stretch without sentence ends of more than ``SHARED`` words is cut into passages of ``USUAL`` words, which together weigh one sentence up to
#: ``LONG`` words and one each beyond. They take no part in the verification.
USUAL, SHARED, LONG = 9, 20, 45

#: Labels of a feature: subjects with their shares.
TAKEN = "array<struct<topic: int, share: double>>"


def words_and_ends(marked: str) -> list[str]:
    """What ``WORD_OR_END`` finds in a line whose blanks are spaces; it runs only on what is neither words nor an end."""
    found: list[str] = []
    for n, sentence in enumerate(marked.replace(",", " ").split("\n")):
        if n:
            found.append("\n")
        if sentence.replace(" ", "").isalnum():
            found += sentence.split()
            continue
        for part in sentence.split():
            if part.isalnum():
                found.append(part)
            else:
                found += WORD_OR_END.findall(part)
    return found


def cut_lines(text: str, common: frozenset[str]) -> tuple[list[Line], list[str]]:
    """The lines of a text, as :func:`textwerk.llm.prose.line_shares` gives them, and the words of each, parted by blanks, with a line feed where a sentence ends."""
    lines, cut, known = [], [], common.__contains__
    for raw in LINE.findall(text):
        if tokens := raw.split():
            plain = " ".join(tokens)
            marked = plain.lower() + " "
            for end in SENTENCE_ENDS:
                marked = marked.replace(end, "\n")
            found = words_and_ends(marked)
            lines.append((raw, len(plain) - len(tokens) + 1, range(len(found) - found.count("\n")), sum(map(known, found))))
            cut.append(" ".join(found))
    return lines, cut


def lines_of_prose(batch: pa.RecordBatch, least: dict[str, float]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Of a batch of cut texts: whether each line is prose, the text of each line, and the lines' marks of each text that has others than prose."""
    ratios = batch.column("ratios")
    n = np.diff(ratios.offsets.to_numpy())
    low = np.array([max(least.get(g, 0.0), 0.0) for g in batch.column("lang").to_pylist()])
    text = np.repeat(np.arange(len(n)), n)
    prose = ratios.flatten().to_numpy(zero_copy_only=False) >= low[text]
    ends, bad = np.cumsum(n), np.bincount(text[~prose], minlength=len(n))
    return prose, text, [prose[e - k : e] if b else None for e, k, b in zip(ends.tolist(), n.tolist(), bad.tolist())]


def kept_sentences(joined: str, prose: np.ndarray | None) -> list[str]:
    """The sentences of two or more words in the lines of prose (all if not told), which are joined first, as lines may be broken anywhere."""
    if prose is not None:
        joined = " ".join(line for line, good in zip(joined.split("\r"), prose.tolist()) if good)
    return [part for raw in joined.replace("\r", " ").split("\n") if " " in (part := raw.strip())]


def seed_words(subjects: DataFrame) -> DataFrame:
    """(word, topic) of the given subjects; words given for two subjects are left out."""
    split = subjects.select("topic", F.explode(F.split(F.lower("top_words"), r"\s*,\s*")).alias("word")).where("word <> ''")
    return split.groupBy("word").agg(F.min("topic").alias("topic"), F.count_distinct("topic").alias("n")).where("n = 1").select("word", "topic")


def cut_texts(rows: DataFrame, text: str, row_id: str, common: dict, lang: Column | None, asked: Column | None) -> DataFrame:
    """(row_id, asked, lang, share, lines, ratios, chars, words) of the texts: their share of common words, and of each line the sentences, what it is judged by, its characters and words."""
    shared = rows.sparkSession.sparkContext.broadcast(common)
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    source = rows.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), wanted.alias("asked"), language(lang).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            shares, joined, lengths, ratios, chars, words = [], [], [0], [], [], []
            for g, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines, cut = cut_lines(t, common.get(g, frozenset()))
                n = [len(line[2]) for line in lines]
                shares.append(sum(line[3] for line in lines) / total if (total := sum(n)) else None)
                joined.append("\r".join(cut)), lengths.append(len(lines)), ratios.extend(line_ratios(lines)), chars.extend(line[1] for line in lines), words.extend(n)
            ends = pa.array(np.cumsum(lengths), pa.int32())
            more = [pa.array(shares, pa.float64()), pa.array(joined, pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((ratios, pa.float32()), (chars, pa.int32()), (words, pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *more], names=["row_id", "asked", "lang", "share", "lines", "ratios", "chars", "words"])

    return source.mapInArrow(run, "row_id bigint, asked boolean, lang string, share double, lines string, ratios array<float>, chars array<int>, words array<int>")


def heard_words(cut_once: DataFrame, seeds: dict[str, int], least: dict[str, float]) -> DataFrame:
    """(word, topic, n): passages of each word in which a seed of one subject leads without the word itself."""
    known = cut_once.sparkSession.sparkContext.broadcast((seeds, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, least = known.value
        all_seeds = frozenset(seeds)
        got: defaultdict[int, Counter] = defaultdict(Counter)

        def counted() -> pa.RecordBatch:
            rows = [(w, s, n) for s, by in got.items() for w, n in by.items()]
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["word", "topic", "n"])

        for batch in batches:
            for joined, marks in zip(batch.column("lines").to_pylist(), lines_of_prose(batch, least)[2]):
                for stretch in kept_sentences(joined, marks):
                    parts = stretch.split()
                    hits = all_seeds.intersection(parts)
                    if not hits or len(parts) > SHARED:
                        continue
                    words = set(parts)
                    if len(led := set(map(seeds.__getitem__, hits))) == 1:
                        got[led.pop()].update(words if len(hits) > 1 else words - hits)
                        continue
                    votes = Counter(map(seeds.__getitem__, hits))
                    for w in words:
                        rest = votes - Counter([seeds[w]]) if w in seeds else votes
                        top = rest.most_common(2)
                        if top and (len(top) == 1 or top[0][1] > top[1][1]):
                            got[top[0][0]][w] += 1
            if sum(map(len, got.values())) > HELD:
                yield counted()
        yield counted()

    return cut_once.select("lang", "lines", "ratios").mapInArrow(run, "word string, topic int, n bigint").groupBy("word", "topic").agg(F.sum("n").alias("n"))


def verdict(heard: DataFrame) -> DataFrame:
    """(feature, n, by): subjects of what each feature heard, (topic, share) with the greatest first, and how often it heard one."""
    total = heard.groupBy("feature").agg(F.sum("n").alias("n"), F.collect_list(F.struct((-F.col("n")).alias("k"), "topic", "n")).alias("by"))
    return total.select("feature", "n", F.transform(F.array_sort("by"), lambda b: F.struct(b["topic"].alias("topic"), (b["n"] / F.col("n")).alias("share"))).alias("by"))


def main_subjects() -> Column:
    """The subjects of ``by`` that have a part worth naming."""
    return F.filter("by", lambda b: b["share"] >= PART)


def several() -> Column:
    """Whether two or three subjects together have most of what was heard."""
    return (F.col("n") >= MIXED_SUPPORT) & (F.size(main_subjects()) <= 3) & (F.aggregate(main_subjects(), F.lit(0.0), lambda a, b: a + b["share"]) >= PURITY)


def features_of(heard: DataFrame, counts: DataFrame, seeds: DataFrame, n_texts: int) -> DataFrame:
    """(word, feature, seed): the words (no numbers) that keep their links, numbered; seeds always do."""
    total = counts.where("word <> ''").groupBy("word").agg(F.sum(F.col("low") + F.col("other")).alias("total"))
    shares = verdict(heard.withColumnRenamed("word", "feature")).withColumnRenamed("feature", "word")
    unclear = (F.col("n") >= SUPPORT) & (F.col("by")[0]["share"] < PURITY) & ~several()
    known = total.join(shares, "word", "left").join(F.broadcast(seeds.withColumnRenamed("topic", "seed")), "word", "left")
    kept = known.where(~F.col("word").rlike(r"^\d+$")).where(F.col("seed").isNotNull() | ((F.col("total") >= max(float(SUPPORT), LEAST_SHARE * n_texts)) & ~F.coalesce(unclear, F.lit(False))))
    return kept.select("word", (F.monotonically_increasing_id() + 1).alias("feature"), "seed")


def passages(cut_once: DataFrame, features: dict[str, int], least: dict[str, float]) -> DataFrame:
    """Rows of two kinds: texts (row_id, asked, n_words, prose_share, size, keys, weights) and vertices (key, features, members)."""
    known = cut_once.sparkSession.sparkContext.broadcast((features, least))
    kinds = {"row_id": pa.int64(), "asked": pa.bool_(), "n_words": pa.int32(), "prose_share": pa.float64(), "size": pa.float64(), "keys": pa.list_(pa.int64()), "weights": pa.list_(pa.float64()), "key": pa.int64(), "features": pa.list_(pa.int64()), "members": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        (number, least), vertices = known.value, {}

        def table(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], k)) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

        def settled() -> pa.RecordBatch:
            found = list(vertices.values())
            vertices.clear()
            return table({"key": [v[0] for v in found], "features": [v[1] for v in found], "members": [v[2] for v in found]})

        for batch in batches:
            keys, weights, sizes = [], [], []
            prose, text, marked = lines_of_prose(batch, least)
            chars, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("chars", "words"))
            n_words = np.bincount(text, counts * prose, batch.num_rows).astype(np.int32)
            prose_shares = np.bincount(text, chars * prose, batch.num_rows) / np.maximum(1, np.bincount(text, chars, batch.num_rows))
            for joined, marks in zip(batch.column("lines").to_pylist(), marked):
                own, weight, size = [], [], 0.0
                for stretch in kept_sentences(joined, marks):
                    words = stretch.split()
                    if len(words) > SHARED:
                        parts = [words[k : k + USUAL] for k in range(0, len(words), USUAL)]
                        each = len(words) / USUAL / len(parts) if len(words) > LONG else 1 / len(parts)
                    else:
                        parts, each = [words], 1.0
                    for part in parts:
                        size += each
                        if found := frozenset(filter(None, map(number.get, part))):
                            if (vertex := vertices.get(found)) is None:
                                ids = sorted(found)
                                vertex = vertices[found] = [xxhash.xxh64_intdigest(" ".join(map(str, ids))) - (1 << 63), ids, 0]
                            vertex[2] += len(words) <= SHARED
                            own.append(vertex[0]), weight.append(each)
                keys.append(own), weights.append(weight), sizes.append(size)
            yield table({"row_id": batch.column("row_id"), "asked": batch.column("asked"), "n_words": n_words, "prose_share": prose_shares, "size": sizes, "keys": keys, "weights": weights})
            if len(vertices) > HELD:
                yield settled()
        yield settled()

    return cut_once.select("row_id", "asked", "lang", "lines", "ratios", "chars", "words").mapInArrow(run, "row_id bigint, asked boolean, n_words int, prose_share double, size double, keys array<bigint>, weights array<double>, key bigint, features array<bigint>, members bigint")


def spoken(links: DataFrame, labels: DataFrame, heavy: list[int]) -> tuple[DataFrame, DataFrame]:
    """Votes (key, topic, weight, feature) of features with one subject, and each vertex's subjects (key, by), the heaviest first."""
    one = labels.where(F.size("taken") == 1).select("feature", F.col("taken")[0]["topic"].alias("topic"), F.col("taken")[0]["share"].alias("weight"))
    votes = split_join(links, one, "feature", heavy).select("key", "topic", "weight", "feature")
    sums = votes.groupBy("key", "topic").agg(F.sum("weight").alias("votes"))
    return votes, sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.round("votes", 9)).alias("k"), "topic"))).alias("by"))


def votes_at(k: int) -> Column:
    """Votes of a vertex's k-th subject, 0 if there are fewer."""
    return F.when(F.size("by") > k, -F.get("by", F.lit(k))["k"]).otherwise(F.lit(0.0))


def round_of(links: DataFrame, labels: DataFrame, heavy: list[int]) -> DataFrame:
    """(feature, topic, n): how often each feature hears a subject from its vertices, each without the feature's own vote."""
    votes, vertices = spoken(links, labels, heavy)
    own = votes.select("key", "feature", F.col("topic").alias("own"), "weight")
    met = links.join(vertices, "key").join(own, ["key", "feature"], "left")
    topic = lambda k: F.get("by", F.lit(k))["topic"]
    # the votes of the two heaviest subjects without this feature
    first = votes_at(0) - F.when(F.col("own") == topic(0), F.col("weight")).otherwise(0.0)
    second = F.greatest(votes_at(1) - F.when(F.col("own") == topic(1), F.col("weight")).otherwise(0.0), votes_at(2))
    leads = F.when(first > second + 1e-9, topic(0)).when((second > first + 1e-9) & (votes_at(1) > votes_at(2) + 1e-9), topic(1))
    return met.select("feature", leads.alias("topic"), "members").where("topic is not null and members > 0").groupBy("feature", "topic").agg(F.sum("members").alias("n"))


def labels_of(features: DataFrame, heard: DataFrame) -> DataFrame:
    """(feature, taken): the labels of the features that are verified by what they heard; seeds are clamped to theirs unless it speaks against them."""
    known = features.select("feature", "seed").join(verdict(heard), "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = lambda topic, share: F.array(F.struct(topic.cast("int").alias("topic"), share.cast("double").alias("share"))).cast(TAKEN)
    own = F.coalesce(F.filter("by", lambda b: b["topic"] == F.col("seed"))[0]["share"], F.lit(0.0))
    strange = (F.col("n") >= SUPPORT) & (own < PURITY)
    clear = (F.col("n") >= SUPPORT) & (F.col("by")[0]["share"] >= PURITY)
    taken = F.when(F.col("seed").isNotNull() & ~strange, one(F.col("seed"), F.lit(1.0))).when(F.col("seed").isNull() & clear, one(F.col("by")[0]["topic"], F.col("by")[0]["share"])).when(several(), main_subjects().cast(TAKEN))
    return known.select("feature", taken.alias("taken")).where("size(taken) > 0")


def propagated(ws: Workspace, links: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, taken) after the rounds; each round's labels are written, and the last ones end the propagation if they equal those before."""
    heavy = heavy_keys(links, "feature")
    start = F.array(F.struct(F.col("seed").alias("topic"), F.lit(1.0).alias("share"))).cast(TAKEN)
    labels = ws.save(features.where("seed is not null").select("feature", start.alias("taken")))
    for _ in range(ROUNDS):
        labels, before = ws.save(labels_of(features, round_of(links, labels, heavy))), labels
        topics = lambda c: F.array_sort(F.transform(c, lambda x: x["topic"]))
        changed = labels.alias("n").join(before.alias("o"), "feature", "full").where(~topics("n.taken").eqNullSafe(topics("o.taken"))).limit(1).count()
        ws.drop(before)
        if not changed:
            break
    return labels


def text_subjects(rows: DataFrame, subjects: DataFrame, text: str = "text", row_id: str = "row_id", lang: Column | None = None, asked: Column | None = None) -> DataFrame:
    """(row_id, topic, share, n_words, prose_share) of all rows, or those that are ``asked``: a row for each subject of which any sentence of the text deals, with its share of sentences.

    Texts without letters, null texts and texts without subjects have no row; repeated rows give repeated rows. The subjects are a small table (``topic``,
    ``top_words``). What is broadcast are the words with links, whose number is bounded by ``LEAST_SHARE`` and not by the texts.
    """
    ws = Workspace(rows.sparkSession)
    counts = word_counts(rows, text, lang)
    cut_once = ws.save(cut_texts(rows, text, row_id, common_of(counts), lang, asked))
    least = least_of(cut_once.select("lang", "share"))
    seeds = ws.save(seed_words(subjects))
    heard = ws.save(heard_words(cut_once, {r["word"]: r["topic"] for r in seeds.collect()}, least))
    features = ws.save(features_of(heard, counts, seeds, cut_once.count()))
    both = ws.save(passages(cut_once, {r["word"]: r["feature"] for r in features.select("word", "feature").collect()}, least))
    texts = ws.save(both.where("keys is not null and asked and row_id is not null").drop("key", "features", "members").withColumn("text", F.monotonically_increasing_id()))
    # one vertex may come from several tasks; its features are the same in all of them
    vertices = ws.save(both.where("features is not null").groupBy("key").agg(F.first("features").alias("features"), F.sum("members").alias("members")))
    links = ws.save(vertices.select("key", "members", F.explode("features").alias("feature")))
    labels = propagated(ws, links, features)

    _, leading = spoken(links, labels, heavy_keys(links, "feature"))
    leads = ws.save(leading.where(votes_at(0) > votes_at(1) + 1e-9).select("key", F.col("by")[0]["topic"].alias("topic"), F.lit(None).cast("array<int>").alias("options")))
    undecided = links.join(leads.select("key"), "key", "left_anti").join(labels, "feature")
    options = undecided.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("taken", lambda x: x["topic"])))).alias("options"))
    settled = ws.save(leads.union(options.select("key", F.lit(None).cast("int").alias("topic"), "options")))
    common_keys = [r["key"] for r in vertices.where(F.col("members") >= LEAST_ROWS).orderBy(F.desc("members")).limit(HEAVIEST).collect()]
    spread = texts.select("text", F.explode(F.arrays_zip("keys", "weights")).alias("p")).select("text", F.col("p.keys").alias("key"), F.col("p.weights").alias("weight"))
    met = ws.save(split_join(spread, settled, "key", common_keys))
    sure = ws.save(met.where("topic is not null").groupBy("text", "topic").agg(F.sum("weight").alias("weight")))
    open_ones = met.where("topic is null").select("text", "key", F.col("weight").alias("more"), F.explode("options").alias("topic"))
    read = open_ones.groupBy("text", "key", "topic").agg(F.sum("more").alias("more")).join(sure.select("text", "topic", "weight"), ["text", "topic"])
    chosen = read.groupBy("text", "key").agg(F.max(F.struct("weight", (-F.col("topic")).alias("t"), "more")).alias("c")).select("text", (-F.col("c.t")).alias("topic"), "c.more")
    added = chosen.groupBy("text", "topic").agg(F.sum("more").alias("more"))
    whole = sure.join(added, ["text", "topic"], "left").join(texts.select("text", "row_id", "n_words", "prose_share", "size"), "text")
    return whole.select("row_id", "topic", ((F.col("weight") + F.coalesce("more", F.lit(0.0))) / F.col("size")).alias("share"), "n_words", "prose_share")


def dealt_with(found: DataFrame) -> DataFrame:
    """(row_id, topic): the subjects with a share of ``SHARE`` or more in prose texts of ``LEAST_WORDS`` or more words."""
    return found.where((F.col("share") >= SHARE - 1e-9) & (F.col("n_words") >= LEAST_WORDS) & (F.col("prose_share") >= 0.5)).select("row_id", "topic")

"""Text statistics, and texts that are lists, tables or junk instead of running prose.

The common words of each language are counted over all texts: words in many texts, mostly written in lower case (so that the nouns and
names of lists are not among them). Statistics are summarised by quantile sketches per language, which merge in bounded size; from them each value gets a
percentile and a robust z-score, and tails are flagged. What is not prose follows from such a score too: a line is in the lower
tail if its share of common words lies ``TAIL`` robust deviations below its language's median, and a text is not prose if more than half of its
characters are in such lines.

Null texts, and texts without letters and digits, have null statistics and no flag.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textwerk.operators.durable import Workspace

WORD = re.compile(r"[^\W_]+")
LINE = re.compile("[^\n\r\x85\u2028\u2029]+")
#: A common word is in lower case in this share of a language's texts at least, and that in this share of all its spellings.
COMMON_SHARE, LOWER_SHARE = 0.002, 0.5
#: It also has this share of all (text, word) pairs of its language, so that a language has at most 1 / PAIR_SHARE common words, however long its texts are.
PAIR_SHARE = 1e-5
#: Robust deviations below the median from which a line's share of common words is in the tail.
TAIL = 7.0
#: A deviation counts as this part of the median at most, as a language of mixed quality has a wide spread.
WIDEST = 0.1
#: Lines that occur in a text this often are repeated matter, not prose.
REPEATED = 4
#: Statistics that are summarised, in the order of the result.
STATISTICS = ("word_count", "ttr_200", "mean_word_len", "symbol_share", "end_mark_share", "common_share", "prose_share")
#: Size parameter of the quantile sketches (Spark's KLL sketches: some kilobytes each, rank error below one per cent), and points that are read from one.
SKETCH, POINTS = 400, 256
#: A sentence of a few words ends within the line.
MARKED = re.compile(r"\w{3,}[.!?](?:\s|$)").search
END = tuple(".!?…:;\"“”'")


def language(column: Column | None) -> Column:
    """Two-letter language; ``de`` for a table without one, ``und`` for null and others."""
    if column is None:
        return F.lit("de")
    two = F.lower(F.substring(F.trim(column), 1, 2))
    return F.when(two.isin("de", "en"), two).otherwise("und")


def different_words(text: str) -> set[str]:
    """The different words of a text; the pattern runs only on the runs without white space that have other characters too."""
    runs = set(text.split())
    words = set(filter(str.isalnum, runs))
    words.update(WORD.findall(" ".join(runs - words)))
    return words


def word_counts(rows: DataFrame, text: str = "text", lang: Column | None = None) -> DataFrame:
    """(lang, word, low, other): in how many texts each word is found in lower case, and in another spelling; ``low`` of the empty word counts the texts.

    Tasks count their own texts and send the counts of their words; counts of one text are never split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, seen = Counter(), {}
        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own := different_words(t):
                    texts[g] += 1
                    seen.setdefault(g, Counter()).update(own)
        out = [(g, "", n, n) for g, n in texts.items()]
        for g, counts in seen.items():
            low, other = Counter(), Counter()
            for w, n in counts.items():
                (low if (folded := w.lower()) == w else other)[folded] += n
            out += [(g, w, n, other[w]) for w, n in low.items() if not w.isdigit()] + [(g, w, 0, n) for w, n in other.items() if w not in low]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "word", "low", "other"])

    source = rows.select(language(lang).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    return Workspace(rows.sparkSession).save(source.mapInArrow(run, "lang string, word string, low bigint, other bigint").groupBy("lang", "word").agg(F.sum("low").alias("low"), F.sum("other").alias("other")))


def common_words(rows: DataFrame, text: str = "text", lang: Column | None = None) -> dict[str, frozenset[str]]:
    """The common words of each language over all texts."""
    return common_of(word_counts(rows, text, lang))


def common_of(counts: DataFrame) -> dict[str, frozenset[str]]:
    """The common words among :func:`word_counts`. Only words that reach the shares come to the driver, at most 1 / ``PAIR_SHARE`` a language."""
    sums = counts.groupBy("lang").agg(F.sum(F.when(F.col("word") == "", F.col("low"))).alias("texts"), F.sum(F.when(F.col("word") != "", F.col("low") + F.col("other"))).alias("pairs")).collect()
    if not sums:
        return {}
    limit = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(max(1.0, COMMON_SHARE * (r["texts"] or 0), PAIR_SHARE * (r["pairs"] or 0)))) for r in sums])
    found = counts.where((F.col("word") != "") & (F.col("low") >= limit) & (F.col("low") >= LOWER_SHARE * (F.col("low") + F.col("other")))).collect()
    return {g: frozenset(r["word"] for r in found if r["lang"] == g) for g in (r["lang"] for r in sums)}


Line = tuple[str, int, list[str], int]


def line_shares(text: str, common: frozenset[str]) -> list[Line]:
    """(line, characters that are not blanks, lower-cased words, number of common words) of the lines that have such characters."""
    out, known = [], common.__contains__
    for line in LINE.findall(text):
        if not line.isspace():
            n = len(line) - line.count(" ")
            words = WORD.findall(line.lower())
            out.append((line, n, words, sum(map(known, words))))
    return out


def line_ratios(lines: list[Line]) -> list[float]:
    """The share of common words by which each line is judged: infinite for a marked sentence, below 0 for repeated matter and lines without a common word.

    Short lines have too few words to judge by themselves; they are judged with the lines around them that are as short.
    """
    repeats = Counter(line[0] for line in lines) if len(lines) >= REPEATED else {}
    out = []
    for k, (line, _, own, known) in enumerate(lines):
        words = len(own)
        if repeats and repeats[line] >= REPEATED:
            out.append(-1.0)
            continue
        if 0 < words < 6:
            for near in (k - 1, k + 1):
                if 0 <= near < len(lines) and len(lines[near][2]) < 12:
                    words, known = words + len(lines[near][2]), known + lines[near][3]
        out.append(-1.0 if not known else math.inf if words <= 8 and MARKED(line) else known / words)
    return out


def prose_of(lines: list[Line], least: float) -> tuple[list[Line], int, int]:
    """(lines of prose, their characters, all characters)."""
    prose = [line for line, ratio in zip(lines, line_ratios(lines)) if ratio >= max(least, 0.0)]
    return prose, sum(line[1] for line in prose), sum(line[1] for line in lines)


def prose_lines(text: str, common: frozenset[str], least: float) -> tuple[list[Line], int, int]:
    """:func:`prose_of` the lines of a text."""
    return prose_of(line_shares(text, common), least)


def statistics_of(text: str | None, common: frozenset[str], least: float) -> tuple | None:
    """The statistics of a text in the order of ``STATISTICS``; nothing for null and letterless texts.

    ``word_count`` counts runs without white space, ``ttr_200`` is the share of different ones among the first 200 in lower case of
    texts with 20 or more, else null; ``symbol_share`` is the share of characters that are neither letters, digits nor white space;
    ``end_mark_share`` the share of lines that end in a mark.
    """
    lines = line_shares(text, common) if text else []
    words = sum(len(x[2]) for x in lines)
    if not words:
        return None
    tokens = text.split()
    _, good, total = prose_of(lines, least)
    visible = sum(map(len, tokens))
    first = [t.lower() for t in tokens[:200]]
    ttr = len(set(first)) / len(first) if len(tokens) >= 20 else None
    ended = sum(x[0].rstrip().endswith(END) for x in lines)
    return (len(tokens), ttr, visible / len(tokens), max(0, visible - sum(len(w) for x in lines for w in x[2])) / len(text), ended / len(lines), sum(x[3] for x in lines) / words, good / total)


def sketches(rows: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], np.ndarray]:
    """Quantiles of each language and statistic over all rows, from sketches that Spark builds by partition and merges in bounded size.

    The driver gets ``POINTS`` points a language and statistic; a statistic without values has none.
    """
    by = rows.groupBy("lang").agg(*[F.kll_sketch_agg_double(s, F.lit(SKETCH)).alias(s) for s in names], *[F.count(s).alias("n_" + s) for s in names])
    ranks = F.array(*[F.lit(k / (POINTS - 1)) for k in range(POINTS)])
    read = by.select("lang", *[F.when(F.col("n_" + s) > 0, F.kll_sketch_get_quantile_double(s, ranks)).alias(s) for s in names]).collect()
    return {(r["lang"], s): np.array(r[s]) for r in read for s in names if r[s]}


def middle_and_spread(points: np.ndarray) -> tuple[float, float]:
    """Median and robust deviation (from the median absolute one) of the quantiles of a sketch."""
    middle = float(np.median(points))
    return middle, 1.4826 * float(np.median(np.abs(points - middle)))


def text_statistics(rows: DataFrame, text: str = "text", row_id: str = "row_id", lang: Column | None = None) -> DataFrame:
    """(row_id, lang, statistics): one row for each row with an id; see :func:`statistics_of`."""
    common = common_words(rows, text, lang)
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast((common, least_share(rows, common, text, lang)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, least = known.value
            langs = batch.column(1).to_pylist()
            found = [statistics_of(t, common.get(g, frozenset()), least.get(g, 0.0)) for t, g in zip(batch.column(2).to_pylist(), langs)]
            columns = list(zip(*[f or (None,) * len(STATISTICS) for f in found])) or [()] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in columns)], names=["row_id", "lang", *STATISTICS])

    source = rows.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), language(lang).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("row_id is not null")
    return source.mapInArrow(run, "row_id bigint, lang string, " + ", ".join(f"{s} double" for s in STATISTICS))


def least_share(rows: DataFrame, common: dict[str, frozenset[str]], text: str = "text", lang: Column | None = None) -> dict[str, float]:
    """The share of common words below which a line is in the tail of its language: ``TAIL`` robust deviations below the median over all texts."""
    known = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, shares = batch.column(0), []
            for g, t in zip(langs.to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(t.lower())
                shares.append(sum(map(known.value.get(g, frozenset()).__contains__, words)) / len(words) if words else None)
            yield pa.RecordBatch.from_arrays([langs, pa.array(shares, pa.float64())], names=["lang", "share"])

    source = rows.select(language(lang).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    return least_of(source.mapInArrow(run, "lang string, share double"))


def least_of(shares: DataFrame) -> dict[str, float]:
    """:func:`least_share` of texts (lang, share) with their shares of common words, null for those without words."""
    out = {}
    for (g, _), points in sketches(shares, ("share",)).items():
        middle, spread = middle_and_spread(points)
        out[g] = middle - TAIL * min(spread or middle, WIDEST * middle)
    return out


def judged(stats: DataFrame) -> DataFrame:
    """The statistics with a percentile ``p_x`` and a robust z-score ``z_x`` of each, and ``not_prose``.

    A text is not prose if less than half of its characters are in lines of prose, that is outside the lower tail of :func:`least_share`;
    ``tails`` names the statistics in the outer percent of their language or more than four robust deviations from its median.
    """
    known = stats.sparkSession.sparkContext.broadcast(sketches(stats.where("word_count is not null"), STATISTICS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for s in STATISTICS:
                v = pdf[s].to_numpy(float)
                p, z = np.full(len(v), np.nan), np.full(len(v), np.nan)
                for g in pdf["lang"].unique():
                    points = known.value.get((g, s))
                    if points is None:
                        continue
                    at = (pdf["lang"] == g).to_numpy()
                    p[at] = (np.searchsorted(points, v[at], "left") + np.searchsorted(points, v[at], "right")) / 2 / len(points)
                    middle, spread = middle_and_spread(points)
                    z[at] = (v[at] - middle) / (spread or points.std() or 1.0)
                p[np.isnan(v)] = np.nan
                pdf["p_" + s], pdf["z_" + s] = p, z
            marks = np.stack([(pdf["p_" + s] <= 0.01) | (pdf["p_" + s] >= 0.99) | (pdf["z_" + s].abs() > 4) for s in STATISTICS]) if len(pdf) else np.zeros((len(STATISTICS), 0))
            pdf["tails"] = [[s for s, m in zip(STATISTICS, column) if m] for column in marks.T]
            pdf["not_prose"] = pdf["prose_share"] < 0.5
            yield pdf

    more = "".join(f", p_{s} double, z_{s} double" for s in STATISTICS)
    return stats.mapInPandas(run, "row_id bigint, lang string, " + ", ".join(f"{s} double" for s in STATISTICS) + more + ", tails array<string>, not_prose boolean")

"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: white space of any kind, as the inside of a Java character class.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The classes of a blank and of any other character; printable ASCII is told first, as the full class is slow for each letter.
BLANK, VISIBLE = rf"[[^!-~]&&[{SPACE}]]", rf"[!-~[^{SPACE}]]"


def strip(text: Column) -> Column:
    """Without white space at both ends; the pattern runs only on texts that begin or end with some."""
    edges = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1)).rlike(f"[{SPACE}]")
    return F.when(edges, F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")).otherwise(text)


def tokens(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    """Number of tokens; null for null."""
    return F.array_size(tokens(text))


def detokenize(text: Column) -> Column:
    """No space before closing marks or after opening ones, single spaces elsewhere."""
    closed = F.regexp_replace(text, r"\s+([.,;:!?%)\]])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(closed, r"([(\[])\s+", "$1"), r"\s+", " "))


def sentence_count(text: Column) -> Column:
    """Parts between ``.!?`` that are followed by white space or a quote; 0 for an empty text, else at least 1."""
    parts = F.size(F.filter(F.split(text, r"[.!?]+[\s\"]+"), lambda p: p.rlike(rf"[^{SPACE}]")))
    return F.when(text.rlike(rf"[^{SPACE}]"), F.greatest(parts, F.lit(1))).otherwise(F.lit(0))


def sentence_marks(text: Column) -> Column:
    """Parts between runs of ``.!?``, at least 1."""
    return F.greatest(F.size(F.filter(F.split(text, r"[.!?]+"), lambda p: p.rlike(rf"[^{SPACE}]"))), F.lit(1))


def mean_length(words: Column) -> Column:
    """Mean number of code points of an array of words; 0 for none."""
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return F.when(F.size(words) > 0, total / F.size(words)).otherwise(F.lit(0.0))


def type_token_ratio(text: Column, window: int = 200, least: int = 20) -> Column:
    """Share of different lower-cased tokens among the first ``window``; null for fewer than ``least``."""
    first = F.slice(tokens(F.lower(text)), 1, window)
    return F.when(F.size(first) >= least, F.size(F.array_distinct(first)) / F.size(first))


def short_label(words: Column, n: int = 3) -> Column:
    """The first ``n`` of comma-separated key words, joined by a slash."""
    return F.array_join(F.slice(F.split(words, ", "), 1, n), "/")


def ellipsis(label: Column, width: int) -> Column:
    """Cut at a word's end within ``width`` characters, with an ellipsis, if longer."""
    cut = F.regexp_replace(F.substring(label, 1, width), r"\s+\S*$", "")
    return F.when(F.length(label) > width, F.concat(cut, F.lit("…"))).otherwise(label)


def interval_bound(text: Column, which: int) -> Column:
    """Lower (1) or upper (2) number of an interval written as ``[lo, hi]``."""
    number = r"(-?\d+(?:\.\d+)?)"
    return F.nullif(F.regexp_extract(text, rf"\[\s*{number}\s*,\s*{number}\s*\]", which), F.lit("")).cast("double")


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words, each padded by a space; a word shorter than n gives itself once for the sizes from there on."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])
        # an n beyond the word repeats the word, once
        usable = F.filter(sizes, lambda n: (n <= F.length(padded)) | (n == low))
        return F.flatten(F.transform(usable, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))))

    return F.flatten(F.transform(tokens(F.lower(text)), of_word))


def l1_normalised(weights: Column) -> Column:
    """Weights divided by their sum; a zero row stays zero. Negative, null and non-finite weights raise an error."""
    bad = F.exists(weights, lambda w: w.isNull() | (w < 0) | F.isnan(w) | (F.abs(w) == float("inf")))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.when(bad, F.raise_error(F.lit("weights must be finite and not negative"))).when(total > 0, F.transform(weights, lambda w: w / total)).otherwise(F.transform(weights, lambda w: F.lit(0.0)))


def argmax(weights: Column, absolute: bool = False) -> Column:
    """0-based place of the first largest weight, by absolute value if asked."""
    w = F.transform(weights, F.abs) if absolute else weights
    return (F.array_position(w, F.array_max(w)) - 1).cast("int")

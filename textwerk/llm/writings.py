"""Texts that differ only in how they are written down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwerk.llm.components import minimum_labels
from textwerk.operators.durable import Workspace
from textwerk.operators.skew import heavy_keys, split_join

#: Fixed pattern: the label of a ``Label: value`` field at the start of a text or after a line break, ``|`` or ``;``.
LABEL = r"[\p{Z}\s]*\p{L}[\p{L}\p{N}]*(?:[ \-_][\p{L}\p{N}]+){0,3}[\p{Z}\s]*:"
#: A canonical key is hot from this share of all rows on; so there are at most 1 / share hot keys.
HOT_SHARE = 1 / 256
#: First-level groups of a hot key.
SALTS = 64


def letters(text: Column) -> Column:
    """Letters and digits in order, case folded (``ß`` equals ``ss``)."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")), "ß|ẞ", "ss")


def written_keys(text: Column) -> Column:
    """(plain, fields): digests of the canonical text, and of the sorted fields of a text made only of fields.

    ``plain`` is null for null texts and for texts without letters and digits; ``fields`` is null unless the text begins
    with a label and has two or more. A line without a label belongs to the field before it.
    """
    whole = letters(text)
    parts = F.filter(F.transform(F.split(text, rf"[\n\r|;]+(?={LABEL})"), letters), lambda p: p != "")
    fielded = text.rlike(rf"^[\s|;]*{LABEL}") & text.rlike(rf"[\n\r|;]{LABEL}")
    joined = F.when(fielded, F.when(F.size(parts) >= 2, F.array_join(F.array_sort(parts), "\u0001")))
    return F.struct(F.when(whole != "", F.unhex(F.md5(whole))).alias("plain"), F.unhex(F.md5(joined)).alias("fields"))


def copies_by_key(keyed: DataFrame, key: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(key, first, n) of keys with two or more rows, split into the hot ones (few, fit to broadcast) and the others.

    Hot keys are found exactly, from partial counts. Their rows are aggregated in two levels, over ``SALTS`` salts and then
    over the key; the one shuffle that counts the others gives their minimum too. The representative is the smallest id.
    """
    ws = Workspace(keyed.sparkSession)
    rows = keyed.where(F.col(key).isNotNull() & F.col(row_id).isNotNull()).select(key, row_id)
    counts = ws.save(rows.groupBy(key).agg(F.min(row_id).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(1000.0, HOT_SHARE * total)
    hot_keys = F.broadcast(counts.where(F.col("n") >= limit).select(key))
    salted = rows.join(hot_keys, key, "left_semi").groupBy(key, F.pmod(F.xxhash64(row_id), F.lit(SALTS)).alias("salt")).agg(F.min(row_id).alias("first"), F.count("*").alias("n"))
    hot = salted.groupBy(key).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return ws.save(hot), counts.where(F.col("n") < limit)


def with_first(keyed: DataFrame, key: str, row_id: str) -> DataFrame:
    """All rows, with ``first``: the smallest id with the same key, or their own where they have no key or no other row has it."""
    hot, cold = copies_by_key(keyed, key, row_id)
    few = hot.select(key, "first")
    hot_rows = keyed.join(F.broadcast(few), key)
    cold_rows = keyed.join(F.broadcast(few.select(key)), key, "left_anti").join(cold.select(key, "first"), key, "left")
    return hot_rows.union(cold_rows.select(*hot_rows.columns)).withColumn("first", F.coalesce("first", row_id))


def keyed_rows(rows: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """(row_id, plain, fields); the texts themselves are not shuffled."""
    return rows.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), written_keys(F.col(f"`{text}`")).alias("k")).select("row_id", "k.plain", "k.fields")


def classes(rows: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """(row_id, first): every row whose text has letters or digits, with the smallest id of the texts that are the same.

    Two texts are the same if their letters and digits agree in order without regard to case, or if both consist of fields that agree in any
    order; texts that are the same as a third one are the same. Rows are first collapsed by their letters; what the
    fields then link are the collapsed classes, a small graph that minimum propagation closes.
    """
    ws = Workspace(rows.sparkSession)
    keyed = ws.save(keyed_rows(rows, text, row_id).where("plain is not null and row_id is not null"))
    base = ws.save(with_first(keyed, "plain", "row_id").select("row_id", "fields", "first"))
    fielded = ws.save(base.where("fields is not null").select("fields", F.col("first").alias("class")).distinct())
    links = ws.save(with_first(fielded, "fields", "class").where("first < class").select(F.col("first").alias("u"), F.col("class").alias("v")).distinct())
    if not links.limit(1).count():
        return base.select("row_id", "first")
    closed = ws.save(minimum_labels(ws, links).select(F.col("vertex").alias("first"), F.col("label").alias("low")))
    return split_join(base.select("row_id", "first"), closed, "first", heavy_keys(base, "first"), "left").select("row_id", F.coalesce("low", "first").alias("first"))


def same_writing(rows: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """(first_row_id, row_id) of every row whose text is the same (see :func:`classes`) as that of a smaller row id, with the smallest such id.

    Null and empty texts, and texts without letters and digits, are the same as none; an empty table gives an empty one.
    """
    return classes(rows, text, row_id).where("first < row_id").select(F.col("first").alias("first_row_id"), "row_id")


def collapsed(rows: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """One row for each text, however written: (row_id, n_copies) with the smallest id of its copies.

    Copies are the rows of one of the :func:`classes`; rows left out there stand for themselves, also
    those with null texts (each null, empty or letterless text stays a row of its own).
    """
    first = same_writing(rows, text, row_id)
    ids = rows.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"))
    one = ids.join(first, "row_id", "left").select(F.coalesce("first_row_id", "row_id").alias("row_id"))
    return one.groupBy("row_id").agg(F.count("*").alias("n_copies"))

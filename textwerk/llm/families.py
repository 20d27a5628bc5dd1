"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textwerk.llm.components import seeded_components
from textwerk.operators.durable import Workspace

#: Written forms of "no key" (fixed values, compared trimmed and in lower case).
NO_KEY = ("", "nan", "na")
#: A key counts as hot from this share of all keyed rows; there can be at most 1 / share hot keys for each column.
HOT_SHARE = 1 / 256
#: Hash buckets in which a level's families are ordered for the split.
BUCKETS = 4096


def clean_key(key: Column) -> Column:
    """Trimmed and lower-cased key; null for null, blank, ``nan`` and ``na``."""
    plain = F.lower(F.regexp_replace(key.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(~plain.isin(*NO_KEY), plain)


def key_links(rows: DataFrame, row_id: str, keys: Sequence[str]) -> DataFrame:
    """Star links (i, j) from the smallest row of each key to its other rows.

    Counts and minima are partial aggregates, so a hot key costs no large group. Rows of a hot key get the key's
    minimum by a broadcast of at most ``len(keys) / HOT_SHARE`` entries, others by a shuffle join.
    """
    ids = F.col(f"`{row_id}`").cast("bigint").alias("_row")
    tagged = rows.select(ids, F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), clean_key(F.col(f"`{k}`")).alias("key")) for n, k in enumerate(keys)])).alias("_k")).where("_k.key is not null and _row is not null").select("_row", F.xxhash64("_k.kind", "_k.key").alias("k1"), F.hash("_k.key", "_k.kind").alias("k2"))
    lows = tagged.groupBy("k1", "k2").agg(F.min("_row").alias("i"), F.count("*").alias("n")).where("n > 1")
    ws = Workspace(rows.sparkSession)
    lows = ws.save(lows)
    total = lows.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(lows.where(F.col("n") >= F.lit(max(2.0, HOT_SHARE * total))).select("k1", "k2", "i"))
    cold = lows.where(F.col("n") < F.lit(max(2.0, HOT_SHARE * total))).select("k1", "k2", F.col("i").alias("cold_i"))
    found = tagged.join(hot, ["k1", "k2"], "left")
    near = found.where("i is not null").select("i", F.col("_row").alias("j"))
    far = found.where("i is null").select("k1", "k2", "_row").join(cold, ["k1", "k2"]).select(F.col("cold_i").alias("i"), F.col("_row").alias("j"))
    return near.union(far).where("i <> j")


def families(rows: DataFrame, row_id: str = "row_id", keys: Sequence[str] = ("cv_group", "pair_id")) -> DataFrame:
    """(row_id, family) of rows that share a key with another row, directly or by way of others; family is the smallest id.

    Rows without a usable key, or alone with it, are left out. Null ids are ignored.
    """
    found = seeded_components(key_links(rows, row_id, keys))
    return found.select(F.col("vertex").alias("row_id"), F.col("label").alias("family"))


def level_of(raw: Column) -> Column:
    """The trimmed, upper-cased level without a trailing ``+`` or ``.`` with digits; null unless one of the six."""
    base = F.regexp_extract(F.upper(raw), r"(?U)^\s*(A1|A2|B1|B2|C1|C2)\s*(?:\+|\.\d+)?\s*$", 1)
    return F.when(base != "", base)


def split_rows(rows: DataFrame, row_id: str = "row_id", keys: Sequence[str] = ("cv_group", "pair_id"), level: str = "cefr_level", shares: dict[str, float] | None = None) -> DataFrame:
    """(row_id, family, split): whole families in one split, shares met over all rows and nearly so within each level.

    Families are ordered by hash within the level most of their rows have (``none`` where no row has one; ties go to
    the smaller level). Cumulative row counts over at most ``BUCKETS`` hash buckets a level choose the two cuts. A family
    larger than a bucket's usual load goes to the first split, and the cuts of its level make up for it.
    Rows with null id are left out; an empty table gives an empty one.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    ws = Workspace(rows.sparkSession)
    fam = families(rows, row_id, keys)
    base = rows.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.coalesce(level_of(F.col(f"`{level}`")), F.lit("none")).alias("level")).where("row_id is not null")
    member = ws.save(base.join(fam, "row_id", "left").select("row_id", "level", F.coalesce("family", "row_id").alias("family")))
    by_level = member.groupBy("family", "level").count()
    fams = by_level.groupBy("family").agg(F.sum("count").alias("n"), F.min(F.struct((-F.col("count")).alias("c"), "level")).alias("m")).select("family", "n", F.col("m.level").alias("stratum"), F.pmod(F.xxhash64("family"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    fams = ws.save(fams)
    sizes = fams.groupBy("stratum").agg(F.sum("n").alias("rows"))
    fams = fams.join(F.broadcast(sizes), "stratum").withColumn("big", (F.col("n") > 8) & (F.col("n") > F.col("rows") / BUCKETS * 64))
    # at most 7 strata x BUCKETS rows from here on, whatever the number of families
    load = fams.where(~F.col("big")).groupBy("stratum", "bucket").agg(F.sum("n").alias("n"))
    big = fams.where("big").groupBy("stratum").agg(F.sum("n").alias("big_n"))
    w = Window.partitionBy("stratum").orderBy("bucket")
    placed = load.withColumn("before", F.sum("n").over(w) - F.col("n") / 2).join(F.broadcast(sizes), "stratum").join(F.broadcast(big), "stratum", "left")
    names = list(shares)
    at = (F.col("before") + F.coalesce("big_n", F.lit(0))) / F.col("rows")
    edge, split = 0.0, F
    for name in names[:-1]:
        edge += shares[name]
        split = split.when(at < edge, name)
    cuts = placed.select("stratum", "bucket", split.otherwise(names[-1]).alias("split"))
    chosen = fams.join(F.broadcast(cuts), ["stratum", "bucket"], "left").select("family", F.when(F.col("big"), names[0]).otherwise(F.col("split")).alias("split"))
    return member.join(chosen, "family").select("row_id", "family", "level", "split")

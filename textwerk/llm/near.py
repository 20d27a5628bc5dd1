"""Near-duplicate records at a similarity threshold, by prefix candidates, Bayesian pruning and exact verification.

Texts are sets of word shingles (``size`` words in a row; words are runs of letters and digits in lower case). Records with the
same set form one class, named by a 64-bit digest of the set; only classes are compared.

1. *Candidates.* Shingles are ordered from rare to common by a count sketch that is computed over all texts.
   Two sets at the threshold must share a shingle among the rarest ``n - ceil(t n) + 1`` of each, so that joining these
   prefixes loses no pair. A shingle in too many prefixes for one task, counted exactly, is dealt to blocks, and each two blocks meet in a cell of their own.
2. *Bayesian pruning.* The MinHash values of a candidate pair are compared a few at a time; after each step the pair is dropped
   if, with a uniform prior, the posterior probability that its similarity reaches the threshold is below ``TOLERANCE``.
3. *Verification.* The rest is verified exactly on the sets.

The order of shingles only steers the amount of work, never the result. The sketch has a slot for every 16 shingles, within bounds; where its slots
are crowded, common shingles still stand out, and only the exact counts tell which of them are hot.
Null texts, and texts with fewer words than asked for, are in no class. Shingles are held as 40-bit fingerprints (32 and 8 bits, in two columns); a text with
2^28 of them or more is refused.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from textwerk.operators.durable import Workspace
from textwerk.operators.skew import HEAVIEST, dealt, pairs_of, split_join

#: Slots of the count sketch, at least and at most: a broadcast of 2 bytes each.
SLOTS, MOST_SLOTS = 1 << 20, 1 << 22
#: Turns in which the shingles are taken: each shuffles its share of the prefixes and frees it. One more takes those that may be hot.
TURNS = 4
#: Rows of a block of a hot shingle.
BLOCK = 4096
#: Classes a task remembers, to pass over their copies.
REMEMBERED = 1_000_000
#: One-bit MinHash values that are compared where prefixes meet.
BITS = 128
#: Further MinHash values of a record, one byte each, and how many are compared in a step.
HASHES, STEP = 96, 16
#: A pair is dropped when the probability that it reaches the threshold is below this.
TOLERANCE = 1e-4

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KNOWN_WORDS = 400_000


class WordHash(dict):
    """Stable 64-bit hashes of words; forgets them when there are too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > _KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[list[str]], size: int, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 40-bit fingerprints of the shingles of each text, one text after the other, and their numbers. There are fewer than 2^24 texts."""
    words = np.fromiter(map(len, texts), np.int64, len(texts))
    if words.max(initial=0) >= 1 << 28:
        raise ValueError("a text has 2^28 words or more")
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(texts)), np.uint64, int(words.sum()))
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), words)
    n = max(0, len(h) - size + 1)
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for k in range(1, size):
            s = s * _MIX + h[k : n + k]
        s = (doc[:n] << np.uint64(40)) | (mixed(s) >> np.uint64(24))
    s = np.sort(s[doc[:n] == doc[size - 1 : size - 1 + n]])
    s = s[np.r_[True, s[1:] != s[:-1]][: len(s)]]
    return s & np.uint64((1 << 40) - 1), np.bincount((s >> np.uint64(40)).astype(np.int64), minlength=len(texts))


def whole(low: list[bytes], high: list[bytes]) -> np.ndarray:
    """Fingerprints from their two columns, one set after the other."""
    return np.frombuffer(b"".join(low), np.uint32).astype(np.uint64) | (np.frombuffer(b"".join(high), np.uint8).astype(np.uint64) << np.uint64(32))


def shingled(rows: DataFrame, text: str, row_id: str, size: int, least_words: int) -> DataFrame:
    """(row_id, key, n, s1, s2, set, high): one row for each text that has enough words; equal sets have equal keys, s1 and s2 are one-bit MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHash()
        for batch in batches:
            cut = [(i, words) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(words := WORD.findall(t.lower())) >= max(least_words, size)]
            if cut:
                flat, n = shingle_sets([words for _, words in cut], size, hashes)
                start = np.cumsum(n) - n
                low = flat.astype(np.uint32)
                bits = one_bits(low, start)
                raw, more = low.tobytes(), (flat >> np.uint64(32)).astype(np.uint8).tobytes()
                at = list(zip(start.tolist(), n.tolist()))
                sets, highs = [raw[4 * x : 4 * (x + k)] for x, k in at], [more[x : x + k] for x, k in at]
                keys = [xxhash.xxh64_intdigest(x + y) - (1 << 63) for x, y in zip(sets, highs)]
                columns = [pa.array([i for i, _ in cut], pa.int64()), pa.array(keys, pa.int64()), pa.array(n, pa.int32()), pa.array(bits[0]), pa.array(bits[1]), pa.array(sets, pa.binary()), pa.array(highs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "key", "n", "s1", "s2", "set", "high"])

    source = rows.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").cast("string").alias("text")).where("row_id is not null and text is not null")
    return source.mapInArrow(run, "row_id bigint, key bigint, n int, s1 bigint, s2 bigint, set binary, high binary")


def log_code(count: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 16 bits, which keeps their order to a part in a thousand at any size."""
    return np.minimum(np.log2(np.maximum(count, 1)) * 1024, 65535).astype(np.uint16)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often each slot's shingles occur over all texts, as :func:`log_code`."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    slots = min(MOST_SLOTS, max(SLOTS, 1 << (int(total) // 16).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32) % slots, minlength=slots)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])

    found = sets.select("set").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(slots, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return log_code(counts)


def needed(t: float, a: int, b: int) -> int:
    """The smallest overlap of sets of a and b elements with similarity t."""
    return math.ceil(t / (1 + t) * (a + b) - 1e-9)


def prefixes(sets: DataFrame, threshold: float, counts: Broadcast, turn: int, turns: int) -> DataFrame:
    """(met, at, key, s1, s2): the rare end of each set, a row for each shingle of this turn, with the set's one-bit MinHash values.

    Rows meet by ``met``, the shingle. ``at`` holds the size of the set and the shingle's place in it. The last turn, ``turns``, has the shingles whose
    slots are counted so often that they may be hot; the others share the rest.
    """
    limit, once = int(log_code(np.array([2 * BLOCK]))[0]), int(log_code(np.array([1]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        code = counts.value
        for batch in batches:
            # copies within the task go here, those of other tasks where the rows meet; what is forgotten is soon learnt again if it is frequent
            if len(seen) >= REMEMBERED:
                seen.clear()
            fresh = [i for i, k in enumerate(batch.column(0).to_pylist()) if k not in seen and not seen.add(k)]
            if not fresh:
                continue
            keys, s1, s2 = (batch.column(c).take(pa.array(fresh)).to_numpy() for c in (0, 1, 2))
            raws, highs = (batch.column(c).take(pa.array(fresh)).to_pylist() for c in (3, 4))
            n = np.fromiter(map(len, highs), np.int64, len(highs))
            flat = np.frombuffer(b"".join(raws), np.uint32)
            doc = np.repeat(np.arange(len(n)), n)
            c = code[flat % len(code)]
            start = np.cumsum(n) - n
            place = np.arange(len(flat)) - start[doc]
            # by text, count and fingerprint, which is the place so far; one plain sort of packed values
            packed = np.sort((doc << 44) | (c.astype(np.int64) << 28) | place)
            order = start[doc] + (packed & 0xFFFFFFF)
            own = c[order] > limit if turn == turns else (c[order] <= limit) & (flat[order] % turns == turn)
            # a slot counted once has no partner
            at = np.flatnonzero((place < (n - np.ceil(threshold * n - 1e-9) + 1)[doc]) & (c[order] > once) & own)
            d = doc[at]
            met = flat[order[at]].astype(np.int64) | (np.frombuffer(b"".join(highs), np.uint8)[order[at]].astype(np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (met, (n[d] << 32) | (place[at] << 1), keys[d], s1[d], s2[d])], names=["met", "at", "key", "s1", "s2"])

    return sets.select("key", "s1", "s2", "set", "high").mapInArrow(run, "met bigint, at bigint, key bigint, s1 bigint, s2 bigint")


def in_cells(ws: Workspace, rows: DataFrame) -> DataFrame:
    """The rows with a ``cell``: those of a hot shingle once for each block of it, with the last bit of ``at`` set if their own block is the second of the cell."""
    rows = ws.save(rows)
    hot = ws.save(rows.groupBy("met").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK))
    heaviest = [r["met"] for r in hot.orderBy(F.desc("n")).limit(HEAVIEST).collect()]
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    dealt = split_join(rows, hot, "met", heaviest, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") > 1, F.least("own", "other").cast("bigint") * (1 << 32) + F.greatest("own", "other") + 1).otherwise(F.lit(0))
    return cells.select("met", cell.cast("bigint").alias("cell"), (F.col("at") + (F.col("own") > F.col("other")).cast("bigint")).alias("at"), "key", "s1", "s2")


def candidates(ws: Workspace, sets: DataFrame, threshold: float, turns: int = TURNS) -> DataFrame:
    """(a, b) keys of classes that may reach the threshold. Meeting in a prefix loses no pair.

    Of a pair, the smaller set needs only its first ``n - ceil(2t / (1 + t) n) + 1`` shingles. Rows are shuffled once, by
    shingle and cell, and sorted; pairs of a sorted stretch are formed with array operations, and most are dropped at
    once by the posterior of their first ``BITS`` MinHash values. Shingles take ``turns``, which bounds the disk in use.
    """
    t, most_unlike = threshold, BITS - least_matches(threshold, BITS, 0.5)[0]

    def meet(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        met, cell, at, key, s1, s2 = rows
        group = np.cumsum(np.r_[True, (met[1:] != met[:-1]) | (cell[1:] != cell[:-1])])
        again = np.r_[False, (key[1:] == key[:-1]) & (group[1:] == group[:-1])]
        group, at, key, s1, s2 = group[~again], at[~again], key[~again], s1[~again].view(np.uint64), s2[~again].view(np.uint64)
        side, place, n = at & 1, (at & 0xFFFFFFFF) >> 1, at >> 32
        index = n - np.ceil(2 * t / (1 + t) * n - 1e-9) + 1
        two = np.zeros(group[-1] + 1, bool)
        two[group[side == 1]] = True
        left, d, found = np.arange(len(key)), 0, []
        while True:
            d += 1
            left = left[: np.searchsorted(left, len(key) - d)]
            left = left[group[left + d] == group[left]]
            if not len(left):
                break
            right = left + d
            swap = (n[left] > n[right]) | ((n[left] == n[right]) & (key[left] > key[right]))
            x, y = np.where(swap, right, left), np.where(swap, left, right)
            nx, ny, px, py = n[x], n[y], place[x], place[y]
            ok = (px < index[x]) & (nx >= t * ny - 1e-9) & (np.minimum(nx - px, ny - py) + np.minimum(px, py) >= np.ceil(t / (1 + t) * (nx + ny) - 1e-9)) & (~two[group[left]] | (side[left] != side[right]))
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(s1[x] ^ s1[y]) + np.bitwise_count(s2[x] ^ s2[y]) <= most_unlike
            if ok.any():
                found.append(np.stack([key[x[ok]], key[y[ok]]]))
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= 250_000:
                rows = [np.concatenate(c) for c in zip(*held)]
                # the last group, of at most two blocks and copies from other tasks, may go on in the next batch
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                last += int(np.searchsorted(rows[1][last:], rows[1][-1]))
                if last:
                    yield from meet([c[:last] for c in rows])
                held = [[c[last:] for c in rows]]
        if held:
            yield from meet([np.concatenate(c) for c in zip(*held)])

    counts = ws.spark.sparkContext.broadcast(shingle_counts(sets))
    parts = None
    for turn in range(turns + 1):
        ws.release()
        rows = prefixes(sets, threshold, counts, turn, turns)
        if turn == turns:
            met = in_cells(ws, rows).repartition("met", "cell").sortWithinPartitions("met", "cell", "key")
        else:
            met = rows.repartition("met").sortWithinPartitions("met", "key").select("met", F.lit(0).cast("bigint").alias("cell"), "at", "key", "s1", "s2")
        part = ws.save(met.mapInArrow(run, "a bigint, b bigint").distinct())
        parts = part if parts is None else parts.union(part)
    return parts.distinct()


@lru_cache
def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of fixed hash functions on 32-bit values."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, count, dtype=np.uint32)


def min_values(flat: np.ndarray, start: np.ndarray, count: int, seed: int) -> Iterator[np.ndarray]:
    """For each hash function, the smallest hash of every set, scrambled; the sets lie one after the other in ``flat``."""
    flat = flat ^ (flat >> np.uint32(15))
    for m, o in zip(*hash_family(count, seed)):
        low = np.minimum.reduceat(flat * m + o, start)
        yield (low ^ (low >> np.uint32(13))) * np.uint32(0x9E3779B1)


def one_bits(flat: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """``BITS`` one-bit MinHash values of every set, packed into 64-bit integers."""
    out = [np.zeros(len(start), np.uint64) for _ in range(BITS // 64)]
    for k, low in enumerate(min_values(flat, start, BITS, 77)):
        out[k // 64] |= (low >> np.uint32(31)).astype(np.uint64) << np.uint64(k % 64)
    return [x.view(np.int64) for x in out]


def signatures(raws: list[bytes]) -> list[bytes]:
    """``HASHES`` MinHash values of each set, one byte each."""
    n = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
    rows = np.stack([(low >> np.uint32(24)).astype(np.uint8) for low in min_values(np.frombuffer(b"".join(raws), np.uint32), np.cumsum(n) - n, HASHES, 78)], axis=1)
    return [r.tobytes() for r in rows]


@lru_cache
def least_matches(threshold: float, step: int, chance: float, total: int | None = None) -> tuple[int, ...]:
    """After each ``step`` of ``total`` values, the smallest number of equal ones with which a pair stays.

    With m of n values equal and a uniform prior of the similarity J, the posterior of J is proportional to
    p^m (1 - p)^(n - m), where p = J + (1 - J) chance, as cut values are equal by chance. The pair stays if
    P(J >= threshold) is at least ``TOLERANCE``.
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) * chance
    out = []
    for n in range(step, (total or step) + 1, step):
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(logs - logs.max())
            if w[j >= threshold].sum() / w.sum() >= TOLERANCE:
                out.append(m)
                break
    return tuple(out)


def pruned(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that survive the incremental comparison of MinHash values."""
    limits = least_matches(threshold, STEP, 1 / 256, HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for k, limit in enumerate(limits):
                at = slice(k * STEP, (k + 1) * STEP)
                matches = matches + (left[alive, at] == right[alive, at]).sum(1)
                keep = matches >= limit
                alive, matches = alive[keep], matches[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["a", "b"])

    x, y = signed.select(F.col("key").alias("a"), F.col("signature").alias("sa")), signed.select(F.col("key").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets reach the threshold, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = [], []
            for i, (left, right, more, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)))):
                p, q = whole([left], [more]), whole([right], [other])
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= needed(threshold, len(p), len(q)):
                    keep.append(i), values.append(both / (len(p) + len(q) - both))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    x, y = sets.select(F.col("key").alias("a"), F.col("set").alias("xa"), F.col("high").alias("ha")), sets.select(F.col("key").alias("b"), F.col("set").alias("xb"), F.col("high").alias("hb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb", "ha", "hb").mapInArrow(run, "a bigint, b bigint, similarity double")


def near_classes(rows: DataFrame, text: str = "text", row_id: str = "row_id", threshold: float = 0.8, size: int = 5, least_words: int = 10) -> tuple[DataFrame, DataFrame]:
    """Members (row_id, key) and links (a, b, similarity) between the classes of equal sets, a < b.

    Every row with at least ``least_words`` words, and a shingle, is a member of one class. Repeated rows are members of the same class;
    an empty table gives two empty ones; other columns are ignored.
    """
    ws = Workspace(rows.sparkSession)
    sets = ws.save(shingled(rows, text, row_id, size, least_words))
    pairs = ws.save(candidates(ws, sets, threshold))
    ws.release()
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # one row of each class, found by aggregates, so that the sets of copies are not brought together
    first = sets.groupBy("key").agg(F.min("row_id").alias("row_id")).join(keys, "key")
    wanted = ws.save(sets.select("row_id", "key", "set", "high").join(first, ["row_id", "key"], "left_semi").select("key", "set", "high").dropDuplicates(["key"]))
    ws.release()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures(batch.column(1).to_pylist()) if batch.num_rows else [], pa.binary())], names=["key", "signature"])

    likely = ws.save(pruned(pairs, wanted.select("key", "set").mapInArrow(sign, "key bigint, signature binary"), threshold))
    links = ws.save(verified(likely, wanted, threshold))
    return sets.select("row_id", "key"), links


def near_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(i, j) row pairs, i < j: rows of one class, and rows of linked classes.

    This is the expansion that a caller asks for; its size is that of the result. The rows of a class are dealt to blocks, and blocks are paired,
    so that no task gets all rows of a class with very many copies.
    """
    placed = Workspace(members.sparkSession).save(dealt(members, "key", "row_id"))
    inside = pairs_of(placed, "key", "row_id").select(F.col("a_row_id").alias("i"), F.col("b_row_id").alias("j"))
    blocks = placed.where("n_blocks > 1").select("key", "n_blocks").distinct()
    many = lambda c: F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1)
    of = lambda side: blocks.select(F.col("key").alias(side), F.col("n_blocks").alias("n" + side))
    cells = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("block_a", F.explode(many("na"))).withColumn("block_b", F.explode(many("nb")))
    one, two = (placed.select(F.col("row_id").alias(i), F.col("key").alias(s), F.col("block").alias("block_" + s)) for i, s in (("i", "a"), ("j", "b")))
    across = cells.join(one, ["a", "block_a"]).join(two, ["b", "block_b"]).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i < j")
    return inside.union(across).distinct()

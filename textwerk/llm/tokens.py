"""Token ids of texts by a public byte-level BPE vocabulary.

Speculate and verify: a word is first cut greedily into longest vocabulary entries by one automaton pass. A cut is the
encoding of the word exactly if every adjacent pair of its tokens is compatible, that is if no merge would ever cross the
border between them; all pairs of a batch are tested together with array operations. Only words with an incompatible
pair are merged step by step. Words repeat, so each is encoded once per task, and a bounded number is remembered.

The vocabulary is a parameter: the path of a tokenizer file, read on the driver and broadcast (its size does not depend on
the texts). Null and empty texts have an empty list of ids. Texts of any length are encoded whole; special tokens are never produced, and
their strings are ordinary text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words remembered by a task.
KNOWN_WORDS = 150_000
#: Fixed value: the public pattern that cuts text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: characters with the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Finds a character beyond the basic plane.
BEYOND = re.compile("[\U00010000-\U0010ffff]").search
_NEVER = np.int64(1) << 40


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public tokenizer file; an unknown name is an error that lists what there is."""
    import os

    import public_tokenizers

    path = public_tokenizers.path(name)
    if not os.path.exists(path):
        raise ValueError(f"no tokenizer file {name}; there are {sorted(x for x in os.listdir(os.path.dirname(path)) if '.' in x)}")
    return path


def byte_of_sign() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


def read_vocabulary(path: str) -> dict:
    """Token bytes by id, and the merges (left, right, merged) in order, of a ``tokenizers`` file of kind byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    model, signs = model["model"], byte_of_sign()
    ids = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merges = []
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        left, right = bytes(signs[c] for c in left), bytes(signs[c] for c in right)
        merges.append((ids[left], ids[right], ids[left + right]))
    return {"ids": ids, "merges": merges}


def basic_class(kind: str) -> str:
    """The code points below U+10000 whose general category begins with ``kind``, as the inside of a character class."""
    member = [k for k in range(0x10000) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k))[0] == kind]
    runs, out = np.split(np.array(member), np.flatnonzero(np.diff(member) > 1) + 1), []
    for run in runs:
        out.append(re.escape(chr(run[0])) + ("-" + re.escape(chr(run[-1]))) * (len(run) > 1))
    return "".join(out)


class Encoder:
    """Encodes words and texts; built once for each Python worker."""

    def __init__(self, vocabulary: dict):
        import ahocorasick
        import regex

        self.ids = vocabulary["ids"]
        self.merges = np.array(vocabulary["merges"], np.int64)
        size = max(self.ids.values()) + 1
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(map(tuple, vocabulary["merges"]))}
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        # the merge that makes a token, and its parts
        self.made, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for r, (a, b, c) in reversed(list(enumerate(vocabulary["merges"]))):
            self.made[c], self.left[c], self.right[c] = r, a, b
        codes = self.merges[:, 0] * size + self.merges[:, 1]
        self.order = np.argsort(codes)
        self.codes, self.size = codes[self.order], size
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        spaced = PATTERN.replace(r"[^\s\p", rf"[^{SPACE}\p").replace(r"\s+(?!\S)", rf"[{SPACE}]+(?![^{SPACE}])").replace(r"|\s+", rf"|[{SPACE}]+")
        self.find_any = regex.compile(spaced).findall
        inner = {kind: basic_class(kind) for kind in "LN"}
        for kind, members in inner.items():  # the standard library's engine is faster, but knows no properties
            spaced = spaced.replace(rf" ?\p{{{kind}}}+", rf" ?[{members}]+").replace(rf"\p{{{kind}}}", members)
        self.find_basic = re.compile(spaced).findall
        self.known: dict[str, list[int]] = {}
        self.compatible: dict[int, bool] = {}
        # whether a token is its own encoding; others are never proposed
        self.whole = np.array([True] * size)
        for t, i in self.ids.items():
            if len(t) > 1 and self.made[i] < 0:
                self.whole[i] = False

    def find(self, text: str) -> list[str]:
        """The words that a text is cut into before merging."""
        return (self.find_any if BEYOND(text) else self.find_basic)(text)

    def spine(self, tokens: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tokens at one side of ``tokens`` through all their merges, last first, and the rank at which each is consumed (never for the token itself)."""
        consumed = np.full(len(tokens), _NEVER)
        while True:
            yield tokens, consumed
            inner = tokens >= 0
            consumed = np.where(inner, self.made[tokens], -1)
            tokens = np.where(inner & (consumed >= 0), part[tokens], -1)
            if not (tokens >= 0).any():
                return

    def crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a merge crosses the border when token ``a`` is followed by token ``b``.

        The border is crossed if, for a token x at the right side of ``a`` and a token y at the left side of ``b``, the merge of x and y comes
        before x and before y is consumed by a merge of its own side. Of equal merges the left one comes first.
        """
        crossed = np.zeros(len(a), bool)
        for x, x_end in self.spine(a, self.right):
            for y, y_end in self.spine(b, self.left):
                code = x * self.size + y
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                rank = np.where((x >= 0) & (y >= 0) & (self.codes[at] == code), self.order[at], _NEVER)
                crossed |= (rank < x_end) & (rank <= y_end) & (rank < _NEVER)
        return crossed

    def merged(self, raw: bytes) -> list[int]:
        """Exact encoding: the first merge of lowest rank, until none applies."""
        parts = [self.byte[b] for b in raw]
        if len(parts) > 200:
            return self.merged_long(parts)
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get((parts[k], parts[k + 1]))
                if r is not None and (best is None or r[0] < best[0]):
                    best, where = r, k
            if best is None:
                break
            parts[where : where + 2] = [best[1]]
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and linked parts, for long words."""
        import heapq

        n = len(parts)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(k: int) -> None:
            if k >= 0 and after[k] < n and (r := self.rank.get((parts[k], parts[after[k]]))) is not None:
                heapq.heappush(heap, (r[0], k, parts[k], parts[after[k]], r[1]))

        for k in range(n - 1):
            push(k)
        while heap:
            _, k, x, y, to = heapq.heappop(heap)
            nxt = after[k]
            if parts[k] != x or nxt >= n or parts[nxt] != y:
                continue
            parts[k], parts[nxt] = to, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            push(k)
            push(before[k])
        return [p for p in parts if p >= 0]

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        """Encodings of new words."""
        out: dict[str, list[int]] = {}
        proposals, raws = [], [w.encode("utf-8", "surrogatepass") for w in words]
        for raw in raws:
            proposals.append([i for _, i in self.automaton.iter_long(raw.decode("latin-1"))])
        pairs = {p[k] * self.size + p[k + 1] for p in proposals for k in range(len(p) - 1)} - self.compatible.keys()
        if pairs:
            codes = np.fromiter(pairs, np.int64, len(pairs))
            bad = self.crossing(codes // self.size, codes % self.size)
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
                return self.learn(words)
            self.compatible.update(zip(codes.tolist(), (~bad).tolist()))
        ok, size, whole = self.compatible, self.size, self.whole
        for w, raw, p in zip(words, raws, proposals):
            good = all(ok[p[k] * size + p[k + 1]] for k in range(len(p) - 1)) and all(whole[i] for i in p)
            out[w] = p if good else self.merged(raw)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        cut = [self.find(t) if t else [] for t in texts]
        known = self.known
        new = [w for w in set(chain.from_iterable(cut)) if w not in known]
        if new:
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = list(set(chain.from_iterable(cut)))
            known.update(self.learn(new))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(broadcast) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    key = broadcast._jbroadcast.id() if getattr(broadcast, "_jbroadcast", None) is not None else id(broadcast)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(broadcast.value)
    return _ENCODERS[key]


def encoded(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every row's text, in one pass without a shuffle.

    Rows with a null id keep it; repeated rows give repeated rows; other columns are ignored.
    """
    vocabulary = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path or tokenizer_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(at, 1000)
                found = encoder.encode(part.column(1).to_pylist())
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=ends[1:])
                values = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "ids"])

    source = rows.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row's text."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path or tokenizer_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in encoder.encode(part.column(1).to_pylist())], pa.int32())], names=["doc_id", "n_tokens"])

    source = rows.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_tokens int")

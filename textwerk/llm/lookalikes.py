"""One form for texts that look the same but differ in their characters.

1. Ignorable characters are deleted, spaces, line breaks and hyphens get one character a kind, and what remains gets its compatibility form.
2. Letters that look alike in Latin, Greek, Cyrillic, Armenian and Cherokee are taken as one sign. A word of such signs is a lattice of readings, and
   Viterbi search finds the best one under character bigrams that were counted over all texts, with a high price
   for a change of script within a word. A word that has a letter of one script only is read in that script.

The reading depends on the signs alone, never on the characters that were found, so that texts that look the same get equal
forms. Case, accents, digits and the number of visible spaces stay. Null stays null; white space at the ends is not visible and is
cut; a text that is empty on the page has the empty form.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textwerk.operators.skew import dealt, heavy_keys, pairs_of, split_join

#: Fixed values, after the public list of confusable characters (UTS 39) as far as the letters are alike in common upright type:
#: letters of Cyrillic, Greek, Armenian and Cherokee, each above the Latin letter that it looks like.
CYRILLIC = "аеорсухѕіјһԁԛԝѵүӏАВЕКМНОРСТУХЅІЈԌԚԜҮЅѴӀ"
CYRILLIC_AS = "aeopcyxsijhdqwvylABEKMHOPCTYXSIJGQWYSVI"
GREEK = "οναρυικγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳͿ"
GREEK_AS = "ovapuikyABEZHIKMNOPTYXCjJ"
ARMENIAN = "օսոհցզԼՍՕ"
ARMENIAN_AS = "ounhgqLUO"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTAJEWMHGZ4RWSVSLCPKB"
#: Other look-alikes of Latin letters, hyphens, and spaces that the compatibility form leaves.
OTHERS = {"ı": "i", "ɡ": "g", "ɑ": "a", "ӏ": "l", "Ӏ": "I", "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "֊": "-"}
LINE_BREAKS = re.compile("\r\n|[\r\x85\u2028\u2029\x0b\x0c]")
BREAK = re.compile("[\r\x85\u2028\u2029\x0b\x0c]").search
#: Ignorable characters beyond the basic plane: tags, variation selectors, and format signs of music and shorthand.
TAGS = re.compile("[\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
BEYOND = re.compile("[\U00010000-\U0010ffff]").search
SPACES = {"\t": " ", "\u1680": " ", "\u180e": None, "\u115f": None, "\u1160": None, "\u034f": None}
#: A joiner between two pictographs makes them one sign and is kept.
JOINER = re.compile("(?<![\u203c-\u3299\U0001f000-\U0001faff\ufe0f])\u200d|\u200d(?![\u203c-\u3299\U0001f000-\U0001faff])")
#: Price of a change of script within a word, in nats; additive smoothing of bigram counts.
SWITCH, SMOOTH = 12.0, 0.5


def one_of(characters: Iterable[str]) -> re.Pattern:
    """A pattern for runs of the characters."""
    return re.compile("[" + "".join(map(re.escape, sorted(characters))) + "]+")


def ignorable() -> re.Pattern:
    """Format and control characters and variation selectors, without joiners, tabs and line breaks."""
    invisible = [chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Cf", "Cc") and chr(c) not in "\t\n\r\x0b\x0c\x85\u200d"]
    return one_of([*invisible, *map(chr, range(0xFE00, 0xFE10))])


def script_of(c: str) -> str:
    """A letter for each of the scripts, else nothing."""
    name = unicodedata.name(c, "")
    return {"LATIN": "L", "GREEK": "G", "CYRILLIC": "C", "ARMENIAN": "A", "CHEROKEE": "K"}.get(name.split(" ")[0], "") if c.isalpha() else ""


_WORD = re.compile(r"[^\W\d_]+")


class Reader:
    """Canonical forms of texts under a table of bigram counts."""

    def __init__(self, bigrams: dict[str, int] | None = None):
        self.ignored = ignorable()
        scripts = ((GREEK, GREEK_AS), (CYRILLIC, CYRILLIC_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS))
        to = {ord(a): b for a, b in [*(pair for script in scripts for pair in zip(*script)), *OTHERS.items(), *SPACES.items()]}
        self.signs, self.signed = to, one_of(map(chr, to))
        self.readings: dict[str, list[str]] = {}
        for letters, like in scripts:
            for a, b in zip(letters, like):
                self.readings.setdefault(b, [b]).append(a)
        ambiguous = "".join(self.readings)
        self.doubtful = re.compile(rf"\b[{ambiguous}]+\b")
        self.foreign = re.compile("[Ͱ-֏Ꭰ-ᏽᲀ-᲏ἀ-῿Ꙁ-ꚟ]")
        self.bigrams = bigrams or {}
        self.starts = Counter()
        for pair, n in self.bigrams.items():
            self.starts[pair[0]] += n
        self.known: dict[str, str] = {}

    def clean(self, text: str) -> str:
        """The compatibility form without ignorable characters."""
        if text.isascii() and text.isprintable():
            return text
        if BREAK(text):
            text = LINE_BREAKS.sub("\n", text)
        if BEYOND(text):
            text = TAGS.sub("", text)
        if "\u200d" in text:
            text = JOINER.sub("", text)
        return unicodedata.normalize("NFKC", self.ignored.sub("", text))

    def sign_text(self, text: str) -> str:
        """The text in signs: look-alike letters as their Latin member, also under accents."""
        text = self.clean(text)
        if not text.isascii():
            plain = unicodedata.normalize("NFD", text)
            signs = self.signed.sub(lambda m: m.group().translate(self.signs), plain)
            text = text if signs == plain else unicodedata.normalize("NFC", signs)
        return text.replace("\t", " ").strip()

    def price(self, a: str, b: str) -> float:
        """Minus the log of the chance that ``b`` follows ``a``; ``^`` begins a word."""
        return -math.log((self.bigrams.get(a + b, 0) + SMOOTH) / (self.starts[a] + 200 * SMOOTH))

    def options(self, sign: str) -> list[str]:
        """The letters that a sign may stand for, with the accents it has."""
        if sign not in self.readings:
            plain = unicodedata.normalize("NFD", sign)
            self.readings[sign] = [unicodedata.normalize("NFC", r + plain[1:]) for r in self.readings[plain[0]]] if len(plain) > 1 and plain[0] in self.readings else [sign]
        return self.readings[sign]

    def read(self, signs: str) -> str:
        """Best reading of a word of signs; of equal ones that with more Latin letters."""
        best = self.known.get(signs)
        if best is None:
            paths = [(0.0, "", "", "^")]  # price, reading, script, last letter; one for each last letter
            for sign in signs:
                after: dict[str, tuple] = {}
                for c in self.options(sign):
                    s = script_of(c[0])
                    for p, done, script, last in paths:
                        cost = p + self.price(last, c) + (SWITCH if s and script and s != script else 0.0)
                        if c not in after or cost < after[c][0]:
                            after[c] = (cost, done + c, s or script, c)
                paths = list(after.values())
            best = min(paths, key=lambda x: x[0])[1]
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[signs] = best
        return best

    def form(self, text: str) -> str:
        """The canonical form of a text."""
        signs = self.sign_text(text)
        if not signs.isascii() and self.foreign.search(signs):
            signs = _WORD.sub(lambda m: self.read(m.group()) if self.foreign.search(m.group()) else m.group(), signs)
        return self.doubtful.sub(lambda m: self.known.get(m.group()) or self.read(m.group()), signs)


def bigram_counts(rows: DataFrame, text: str) -> dict[str, int]:
    """Counts of letter pairs, and of first letters as ``^x``, over the words of all texts that have letters of one script only.

    The table is bounded by the square of the number of letters of these scripts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words, script = Counter(), Counter(), {}

        def settle() -> None:
            for w, n in words.items():
                if len({script.setdefault(c, script_of(c)) for c in w}) == 1 and script[w[0]]:
                    pairs["^" + w[0]] += n
                    for a, b in zip(w, w[1:]):
                        pairs[a + b] += n
            words.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words.update(_WORD.findall(t))
            if len(words) > 200_000:
                settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

    source = rows.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    return {r["pair"]: r["n"] for r in source.mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def _read(rows: DataFrame, text: str, doc_id: str, digests: bool) -> DataFrame:
    counts = rows.sparkSession.sparkContext.broadcast(bigram_counts(rows, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts.value)
        md5 = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(at, 1000)
                raw = part.column(1).to_pylist()
                forms = [None if t is None else reader.form(t) for t in raw]
                if digests:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([md5(f) if f else None for f in forms], pa.binary()), pa.array([md5(t) if t else None for t in raw], pa.binary())], names=["doc_id", "form", "raw"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(forms, pa.string())], names=["doc_id", "form"])

    source = rows.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, form binary, raw binary" if digests else "doc_id bigint, form string")


def forms(rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, form) of every row. Repeated rows give repeated rows; other columns are ignored."""
    return _read(rows, text, doc_id, False)


def form_classes(rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, form, raw): digests of the form and of the text itself; rows that are null or empty on the page are left out."""
    return _read(rows, text, doc_id, True).where("form is not null and doc_id is not null")


def unlike_pairs(classes: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of rows with equal forms and unequal texts, the smaller id first.

    Only forms that have two or more different texts are joined; these are found from partial aggregates. Rows of a form are dealt to
    blocks, and blocks are paired, so that no task gets all rows of a form that very many texts have.
    """
    mixed = classes.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    some = split_join(classes, mixed, "form", heavy_keys(classes, "form"), "left_semi").distinct()
    met = pairs_of(dealt(some, "form", "doc_id"), "form", "doc_id", ["raw"]).where("a_raw <> b_raw")
    return met.select(F.col("a_doc_id").alias("doc_id_a"), F.col("b_doc_id").alias("doc_id_b")).distinct()

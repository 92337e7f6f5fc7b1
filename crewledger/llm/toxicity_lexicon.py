"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, letters that look alike in other scripts, and digits or signs that stand for letters
within a word. What is left are words with one blank between them. An entry of the lexicon is a word or the
beginning of words; its weight is a cautious log-odds of its documents among toxic and other labelled ones.
One pass of the automaton finds all entries and all exception phrases; a hit inside an exception phrase does not count,
and of several entries at one place the heaviest does. The sum of the weights is normalised by length and
turned into a score by a logistic curve in which both labels weigh the same.

Learned from at most SAMPLE labelled documents of either label that are not held out, those with the least hash of their id. Copies and
near copies among them count once. Entries, phrases and bins that reach the driver are at most MOST_TERMS, MOST_TERMS and
2 * BINS.

Defined cases: a null text is empty; an empty text has the score of one without hits; without labels of both kinds there is
no lexicon and every score is 0; a null label is none, of several labels of a document the greatest counts; a null id
is not labelled and not held out; repeated rows are scored alike.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm.frames import add_columns, free_name, map_slices, reach_package, settled
from crewledger.llm.words import mix, window_hashes, word_hashes

SAMPLE, MOST_TERMS = 10_000, 5_000
# Beginnings of words that may be entries, in letters.
SHORTEST, LONGEST = 4, 12
# Standard deviations that a weight is less than its estimate, and documents an entry occurs in at least.
CAUTION, LEAST = 2.3, 2
# Entries with less than this share of the greatest weight are noise.
LEAST_WEIGHT = 0.25
# Words from which on the length of a text counts against its hits, by its logarithm.
SHORT_TEXT = 100
BINS, BIN_WIDTH = 2048, 1 / 64
SPAN = 5

# Digits and signs that are written for letters, and letters of other scripts that look like Latin ones.
DIGITS = str.maketrans("013457896@$!", "oieastbggasi")
LOOKALIKES = str.maketrans(dict(pair for pair in (
    # Cyrillic
    "аa вb сc ԁd еe һh іi јj кk мm нh оo рp ԛq ѕs тt уy хx ԝw зe"
    # Greek
    " αa βb εe ηn ιi κk νv οo ρp τt υu χx ωw"
    # Latin
    " ıi łl øo đd ßb"
).split()))
MARKS = dict.fromkeys(itertools.chain(range(0x300, 0x370), range(0x200B, 0x2010), [0xAD, 0xFEFF]))
LETTER = r"[^\W\d_]"
DISGUISED = re.compile(rf"(?<={LETTER})[0-9@$!]+(?={LETTER})|(?<!\w)[0-9@$]+(?={LETTER})|(?<={LETTER})[0-9@$]+(?!\w)")
BETWEEN = re.compile(r"[\W\d_]+")
ASCII_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str) -> str:
    """The words of a text in their folded form, one blank around each; a blank alone if there are none."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(MARKS).lower().translate(LOOKALIKES)
        text = DISGUISED.sub(lambda m: m[0].translate(DIGITS), text)
        words = BETWEEN.sub(" ", text).strip()
    else:
        text = DISGUISED.sub(lambda m: m[0].translate(DIGITS), text)
        words = b" ".join(text.encode().translate(ASCII_LETTERS).split()).decode()
    return f" {words} " if words else " "


def terms_of(words: set[str]) -> set[str]:
    """What could be an entry for some words: each whole, and its beginnings."""
    found = {f" {w} " for w in words}
    for w in words:
        found.update(f" {w[:n]}" for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return found


class Lexicon:
    """Entries with weights, exception phrases, and the slope and offset of the score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], slope: float = 0.0, offset: float = -math.inf) -> None:
        self.weights, self.exceptions, self.slope, self.offset = weights, exceptions, slope, offset
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # each worker builds its own

    def key_figures(self) -> tuple:
        return sorted(self.weights.items()), sorted(self.exceptions), self.slope, self.offset

    def with_exceptions(self, exceptions: list[str]) -> Lexicon:
        return Lexicon(self.weights, exceptions, self.slope, self.offset)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(term, (term, weight))
            for phrase in self.exceptions:
                found.add_word(phrase, (phrase, 0.0))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, words: str) -> dict[int, str]:
        """The heaviest entry at each place of a folded text, unless an exception phrase covers it."""
        best: dict[int, tuple[float, str]] = {}
        if not self.weights:
            return {}
        covered = []
        for end, (term, weight) in self.automaton().iter(words):
            start = end - len(term) + 1
            if not weight:
                covered.append((start, end))
            elif start not in best or weight > best[start][0]:
                best[start] = weight, term
        outside = dict.fromkeys(best)
        for low, high in covered:
            # The entry starts with the blank before its word, and so does each word of a phrase.
            for start in (s for s in range(low, high) if s in outside):
                del outside[start]
        return {start: best[start][1] for start in outside}

    def density(self, words: str) -> float:
        """The weights of the entries in a text, repetitions counting ever less, normalised by its length."""
        found = Counter(self.hits(words).values())
        if not found:
            return 0.0
        total = sum(self.weights[term] * (1 + math.log(times)) for term, times in found.items())
        return total / (1 + math.log1p((words.count(" ") - 1) / SHORT_TEXT))

    def score(self, density: float) -> float:
        x = self.slope * density + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def held_out(id_column: str = "doc_id") -> Column:
    """Documents whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, text: str, id_column: str, label: str, size: int) -> DataFrame:
    """(toxic, words): folded texts of a bounded sample of labelled documents, near copies once."""
    usable = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    usable = usable.filter(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("id"))
    chosen = settled(usable.filter("toxic = 1").orderBy("h", "id").limit(size).union(usable.filter("toxic = 0").orderBy("h", "id").limit(size)))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen.select("id", "toxic")), "id")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [folded(x or "") for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([likeness(w) for w in words], pa.int64()), batch.column("toxic"), pa.array(words, pa.string())],
                                          names=["g", "toxic", "words"])

    alike = map_slices(rows, "text", "g long, toxic int, words string", make)
    # One text of a group of near copies; ids that many rows share are bounded again.
    return settled(alike.groupBy("g", "toxic").agg(F.min("words").alias("words")).orderBy(F.xxhash64("g"), "toxic").limit(2 * size).select("toxic", "words"))


def likeness(words: str) -> int:
    """The least hash of five words of a folded text: near copies mostly share it."""
    split = [w.encode() for w in words.split()]
    hashes = word_hashes(split)
    found = window_hashes(hashes, min(SPAN, len(split))) if split else np.zeros(1, np.uint64)
    return int(mix(found).min().view(np.int64))


COUNTS = "term string, a long, b long"


def _counted(rows: DataFrame, terms) -> DataFrame:
    """(term, a, b): toxic and other texts that hold what `terms` names in a text."""
    reach_package(rows.sparkSession)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = {0: Counter(), 1: Counter()}
        for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
            of[toxic].update(terms(words))
        names = list(of[1] | of[0])
        return pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "a": pa.array([of[1][t] for t in names], pa.int64()),
                                           "b": pa.array([of[0][t] for t in names], pa.int64())})

    return map_slices(rows, "words", COUNTS, make).groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _column_odds(toxic: int, clean: int) -> tuple[Column, Column]:
    estimate = F.expr(f"ln((a + 0.5) / {toxic + 1}) - ln((b + 0.5) / {clean + 1})")
    return estimate, F.expr(f"{CAUTION} * sqrt(1 / (a + 0.5) + 1 / (b + 0.5))")


def entries_of(counted: list[tuple[str, float, int]]) -> dict[str, float]:
    """Weights of the entries kept, from (term, weight, toxic texts) of all candidates.

    A term goes if a shorter one that begins it weighs as much, or if a longer one that it begins weighs more and is
    where nearly all of its toxic texts come from.
    """
    kept: dict[str, float] = {}
    least = LEAST_WEIGHT * max((weight for _, weight, _ in counted), default=0.0)
    heavier: dict[str, int] = {}  # toxic texts of the entries kept that a string begins
    for term, weight, toxic in sorted(counted, key=lambda t: (-t[1], len(t[0].rstrip()), t[0])):
        begins = [term[:n] for n in range(SHORTEST + 1, len(term))]
        if weight < least or any(b in kept for b in begins) or toxic < 1.2 * heavier.get(term, 0):
            continue
        kept[term] = weight
        for b in begins:
            heavier[b] = max(heavier.get(b, 0), toxic)
    return kept


def fitted(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (density, label, count), either label weighing the same in all."""
    x = np.array([p[0] for p in points])
    y = np.array([p[1] for p in points], float)
    n = np.array([p[2] for p in points], float)
    n = np.where(y == 1, n / n[y == 1].sum(), n / n[y == 0].sum()) * n.sum() / 2
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([((p - y) * n * x).sum() + 0.5 * a, ((p - y) * n).sum() + 1e-3 * b])
        hessian = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def learned(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "toxic", size: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled documents that are not held out."""
    rows = sample(docs, labels, text, id_column, label, size)
    numbers = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = numbers.get(1, 0), numbers.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, [])
    estimate, caution = _column_odds(toxic, clean)
    counted = _counted(rows, lambda words: terms_of(set(words.split())))
    entries = counted.filter(f"a >= {LEAST}").withColumn("weight", estimate - caution).filter("weight > 0").orderBy(F.desc("weight"), "term").limit(MOST_TERMS)
    lexicon = Lexicon(entries_of([(r.term, r.weight, r.a) for r in entries.collect()]), [])

    def contexts(words: str) -> set[str]:
        """The word at each hit, and with the word before and after it."""
        found = set()
        for start in lexicon.hits(words):
            end = words.index(" ", start + 1)
            before, after = words.rfind(" ", 0, start), words.find(" ", end + 1)
            found.add(words[start : end + 1])
            if start > 0:
                found.add(words[before : end + 1])
            if after > 0:
                found.add(words[start : after + 1])
        return found

    # A phrase without toxic texts has a wide deviation already; one of it is enough.
    surely = estimate + caution / CAUTION
    phrases = _counted(rows, contexts).filter(surely < 0).orderBy(surely, "term").limit(MOST_TERMS)
    whole = lexicon.with_exceptions([r.term for r in phrases.collect()])

    def bins(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [min(round(whole.density(w) / BIN_WIDTH), BINS) for w in batch.column("words").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("toxic")], names=["bin", "toxic"])

    points = map_slices(rows, "words", "bin int, toxic int", bins).groupBy("bin", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    whole.slope, whole.offset = fitted(sorted((r.bin * BIN_WIDTH, r.toxic, r.n) for r in points))
    return whole


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the score of each text in a new last column."""
    reach_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make(texts: pa.Array) -> list[pa.Array]:
        known = shared.value
        return [pa.array([known.score(known.density(folded(x or ""))) for x in texts.to_pylist()], pa.float64())]

    return add_columns(docs, text, [T.StructField(free_name(docs, name), T.DoubleType())], make)

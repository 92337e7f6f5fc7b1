"""Collocations from the counts of longest windows alone.

Every word occurrence stands in front of a window: itself and the up to three words that follow in its piece,
padded at the end of the piece. Only these longest windows are counted. Spark's ROLLUP over (lang, w1, w2, w3, w4) then
sums each count into ever shorter prefixes, which gives the occurrences of all phrases of one to four
words, and per language of all words, without counting each length on its own.

Most windows of ordinary text occur once, so they travel packed: a task puts the distinct windows of a slice of text into
lines, and the lines of windows that begin with the same pair of words go to the same part. There all windows of a pair are
together, a window is cut back to its longest prefix with enough occurrences, and the rollup gets few rows. A pair that holds
a good share of a sample of the text is dealt by its third word as well and never cut back to one word, as its
occurrences are spread. No step depends on how large the table is.

Defined cases: a null text is empty; a null language is `und`; repeated rows count again; an empty table has no
phrases; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewledger.llm.frames import reach_package, settled, slices
from crewledger.llm.words import Words, encoded, mix, seeds, word_hashes

LONGEST, LEAST, INSIDE, FIRST = 4, 30, 80, 2000
# Parts that windows are dealt to by their first two words.
PARTS = 1 << 14
# Pairs with more than this share of a task's sampled windows are dealt by three words; at most MOST_HOT of them are sent to every task.
HOT_SHARE, MOST_HOT, SAMPLED = 1 / 2000, 4096, 0.02
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
PACKED = "part int, hot boolean, lang string, c long, lines string"

PIECE_END = b"\xff"  # a byte that UTF-8 never holds
READABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + PIECE_END * 10)
MARK = b" " + PIECE_END + b" "


class Stream:
    """The words of a slice of texts in one row, with the piece each stands in.

    `ids` numbers words from 1, `vocabulary` has the word of each, `lang` the number of the language of each word.
    """

    def __init__(self, batch: pa.RecordBatch) -> None:
        langs = batch.column("lang").dictionary_encode()
        self.langs: list[str] = langs.dictionary.to_pylist()
        words = Words([x.translate(READABLE).replace(PIECE_END, MARK) for x in encoded(batch.column("text"))])
        mark = np.flatnonzero(np.array([w == PIECE_END for w in words.vocabulary], bool))
        ends = np.isin(words.ids, mark)
        text = words.text_of()
        # Pieces end at a mark and with the text.
        piece = np.cumsum(ends) + text
        kept = ~ends
        self.ids, self.piece = words.ids[kept] + 1, piece[kept]
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[text[kept]]
        self.vocabulary = words.vocabulary
        with np.errstate(over="ignore"):
            of_lang = mix(word_hashes([x.encode() for x in self.langs]) + np.uint64(1))
            self.hashes = mix(np.concatenate([[np.uint64(0)], word_hashes(words.vocabulary)])[self.ids] ^ of_lang[self.lang])

    def followed(self, steps: int = 1) -> np.ndarray:
        """Whether `steps` more words of the same piece follow a word."""
        found = np.zeros(len(self.ids), bool)
        if len(self.ids) > steps:
            found[:-steps] = self.piece[:-steps] == self.piece[steps:]
        return found

    def pair_hashes(self) -> np.ndarray:
        """A hash of each word and the one after it."""
        first, second = seeds(2, 12) | np.uint64(1)
        with np.errstate(over="ignore"):
            return mix(self.hashes[:-1] * first + self.hashes[1:] * second)


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[Stream]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = Stream(part)
            if len(found.ids):
                yield found


def hot_pairs(texts: DataFrame, share: float = HOT_SHARE, sampled: float = SAMPLED) -> np.ndarray:
    """Hashes of the pairs of words that a sample of the texts is full of, in ascending order.

    They only decide how windows are dealt; any set gives the same counts.
    """
    reach_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in streams(batches):
            pairs, times = np.unique(found.pair_hashes()[found.followed()[:-1]], return_counts=True)
            often = times > max(1, share * len(found.ids))
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs[often].view(np.int64)), "n": pa.array(times[often].astype(np.int64))})

    counted = texts.sample(sampled, seed=1).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "pair").limit(MOST_HOT).collect()
    return np.sort(np.array([r.pair for r in rows], np.int64).view(np.uint64))


def longest_windows(found: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of a slice as word numbers (0 pads), where each first stands, and how often it occurs."""
    count = len(found.ids)
    columns = np.zeros((count, LONGEST), np.int64)
    columns[:, 0] = found.ids
    for k in range(1, min(LONGEST, count)):
        columns[: count - k, k] = np.where(found.followed(k)[: count - k], found.ids[k:], 0)
    if len(found.vocabulary) < (1 << 21) - 1:
        keys = [(columns[:, 0] << 42) | (columns[:, 1] << 21) | columns[:, 2], (columns[:, 3] << 32) | found.lang]
    else:
        keys = [*columns.T, found.lang]
    order = np.lexsort(keys[::-1])
    new = np.zeros(count, bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    first = order[starts]
    return columns[first], first, np.diff(np.append(starts, count))


def packed_windows(found: Stream, hot: np.ndarray) -> pa.RecordBatch:
    """The distinct windows of a slice in lines by part, those that occur once together and each other one in a row of its own."""
    table, first, times = longest_windows(found)
    names = pa.array([w.decode(errors="ignore") for w in found.vocabulary], pa.string())  # the mark between pieces is no text
    # A window of one word goes by that word, one of more by its first two, a hot one by three.
    pairs = np.append(found.pair_hashes(), np.uint64(0))[first]
    is_hot = (table[:, 1] > 0) & np.isin(pairs, hot)
    third = np.append(found.hashes, np.zeros(2, np.uint64))[first + 2]
    with np.errstate(over="ignore"):
        key = np.where(table[:, 1] > 0, pairs, found.hashes[first])
        key = np.where(is_hot & (table[:, 2] > 0), mix(key + third * np.uint64(3)), key)
    part = (key % np.uint64(PARTS)).astype(np.int64)
    lang = found.lang[first].astype(np.int64)
    alone = times == 1
    group = (((lang << 1) | is_hot) << 15 | part) << 1 | ~alone
    order = np.argsort(group, kind="stable")
    group, times = group[order], times[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (group[1:] != group[:-1]) | (times[1:] > 1)
    at = np.flatnonzero(begins)
    words = [names.take(pa.array(np.maximum(table[order, k] - 1, 0), mask=table[order, k] == 0)) for k in range(LONGEST)]
    windows = pc.binary_join_element_wise(*words, " ", null_handling="skip")
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), windows), "\n")
    group = group[at] >> 1
    langs = pa.array(found.langs, pa.string()).take(pa.array(group >> 16))
    return pa.RecordBatch.from_arrays(
        [pa.array((group & 0x7FFF).astype(np.int32)), pa.array(((group >> 15) & 1).astype(bool)), langs, pa.array(times[at].astype(np.int64)), lines],
        names=["part", "hot", "lang", "c", "lines"])


def windows(texts: DataFrame, hot: np.ndarray, least: int) -> DataFrame:
    """(lang, w1..w4, c): the counted longest windows, each cut back to a prefix that may have `least` occurrences."""
    reach_package(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in streams(batches):
            yield packed_windows(found, shared.value)

    dealt = texts.mapInArrow(run, PACKED).repartition("part")
    # From here to the rollup everything stays in its part.
    counted = dealt.select("part", "hot", "lang", "c", F.explode(F.split("lines", "\n")).alias("line")).groupBy(
        "part", "lang", "line", "hot").agg(F.sum("c").alias("c"))
    split = counted.select(
        "part", "hot", "lang", "c", F.split("line", " ").alias("w"), F.substring_index("line", " ", 2).alias("two"), F.substring_index("line", " ", 3).alias("three"))
    of_three = F.sum("c").over(Window.partitionBy("two", "lang", "part", "three"))
    of_two = F.sum("c").over(Window.partitionBy("two", "lang", "part"))
    summed = split.withColumn("f3", of_three).withColumn("f2", of_two)
    enough = [F.lit(True), F.col("hot") | (F.col("f2") >= least), F.col("f3") >= least, F.col("c") >= least]
    return summed.select("lang", *[F.when(enough[k], F.get("w", F.lit(k))).alias(word) for k, word in enumerate(WORDS)], "c")


def phrases(counted: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, f): occurrences of the phrases of one to LONGEST words with at least `least`, and of all words (k = 0)."""
    rolled = counted.rollup("lang", *WORDS).agg(F.grouping_id().alias("level"), F.sum("c").alias("f"))
    # The levels of a rollup have 1, 3, 7, ... as their ids: as many low bits as columns are summed over.
    k = F.lit(LONGEST) - F.bit_count("level")
    whole = F.lit(False)
    for n, word in enumerate(["lang", *WORDS]):
        whole = whole | ((k == n) & F.col(word).isNotNull())  # a prefix that ends in padding is no phrase
    kept = rolled.withColumn("k", k).filter("k >= 0").filter(whole & ((F.col("k") == 0) | (F.col("f") >= least)))
    return kept.select("lang", "k", F.concat_ws(" ", *WORDS).alias("phrase"), "f")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, inside: int = INSIDE, first: int = FIRST,
    hot_share: float = HOT_SHARE, sampled: float = SAMPLED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    counted = windows(texts, hot_pairs(texts, hot_share, sampled), least)
    return best_phrases(settled(phrases(counted, least)), inside, first)


def best_phrases(found: DataFrame, inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """The result from the occurrences of all phrases."""
    candidates = found.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    def joined(words: str, start: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    cut = candidates.select("lang", "phrase", "a", "words", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("at")).select(
        "lang", "phrase", "a", "at", joined("words", F.lit(1), F.col("at")).alias("head"), joined("words", F.col("at") + 1, F.col("k") - F.col("at")).alias("tail"))
    parts = found.filter("k between 1 and 3")
    scored = cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # A score is at most a million, what it is divided from may pass 64 bits.
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("cut"))

    # Where in a longer phrase a shorter one of two words or more stands.
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    longer = candidates.filter("k > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    held = F.expr(f"longest is not null and cast(longest as decimal(19, 0)) * 100 >= cast(a as decimal(19, 0)) * {inside}")
    free = lowest.join(longer, ["lang", "phrase"], "left").filter(~held)
    # A language's best are taken in each task before they meet.
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {first}")
    totals = found.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").cast("long").alias("score"))

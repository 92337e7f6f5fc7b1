"""Languages of a document as a mixture, fitted by expectation-maximisation over its words.

Every word has a likelihood under each language from hashed letter n-grams, counted over all training
documents. For each document EM estimates the proportions of the languages; among the nested sets of its
largest languages the one with the best penalised likelihood is selected, and its largest member predicted.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is everything if no
document has a language to learn from; repeated rows are predicted alike; a null doc_id is held in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm.frames import add_columns, free_name, reach_package, segment_starts, slices, tidy
from crewledger.llm.words import Words, encoded, mix

# N-grams are counted in this many cells per language, which bounds the model a task is sent.
CELLS = 1 << 16
MOST_LANGUAGES = 128
SIZES = (2, 3, 4)
SMOOTHING = 0.5
ROUNDS, REFINING = 8, 4
# Each language beyond the first must gain this many times half the logarithm of the number of words.
PENALTY = 4.0

LETTER = regex.compile(r"\p{L}")
# Bytes of ASCII that are no letters are taken out of words; the others are lower-cased before.
NO_LETTERS = bytes(b for b in range(33, 127) if not 97 <= b <= 122)


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode().lower().encode().translate(None, NO_LETTERS) for t in texts]


def word_grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of all words end to end, and how many each word has; words are framed by blanks."""
    framed = [b" " + w + b" " for w in vocabulary]
    length = np.fromiter(map(len, framed), np.int64, len(framed))
    flat = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    starts = segment_starts(length)
    owner = np.repeat(np.arange(len(framed)), length)
    place = np.arange(len(flat)) - starts[owner]
    cells, owners = [], []
    for size in SIZES:
        key = np.full(max(0, len(flat) - size + 1), size, np.uint64)
        for k in range(size):
            key = key << np.uint64(8) | flat[k : k + len(key)]
        whole = place[: len(key)] + size <= length[owner[: len(key)]]
        cells.append((mix(key[whole]) & np.uint64(CELLS - 1)).astype(np.int64))
        owners.append(owner[: len(key)][whole])
    owner, cell = np.concatenate(owners), np.concatenate(cells)
    order = np.argsort(owner, kind="stable")
    return cell[order], np.bincount(owner, minlength=len(framed)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, cell, n) over all rows (text, lang), summed per task before the shuffle."""
    reach_package(docs.sparkSession)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(lowered(encoded(part.column("text"))))
                cells, counts = word_grams(words.vocabulary)
                coded = part.column("lang").dictionary_encode()
                lang = coded.indices.to_numpy(zero_copy_only=False)[words.text_of()]
                word = np.repeat(np.arange(len(counts)), counts)
                for n, name in enumerate(coded.dictionary.to_pylist()):
                    often = np.bincount(words.ids[lang == n], minlength=len(counts))
                    found = np.bincount(cells, weights=often[word], minlength=CELLS)
                    total[name] = total[name] + found if name in total else found
        for name, found in total.items():
            cell = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(found[cell].astype(np.int64))],
                names=["lang", "cell", "n"])

    return docs.mapInArrow(tidy(run), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of every cell under each, from all labelled documents not held out."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(id_column))
    counts = gram_counts(rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((len(languages), CELLS), SMOOTHING)
    found = counts.toArrow()
    if found.num_rows:
        number = {name: n for n, name in enumerate(languages)}
        row = np.fromiter((number[x] for x in found.column("lang").to_pylist()), np.int64, found.num_rows)
        table[row, found.column("cell").to_numpy()] += found.column("n").to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


class Mixture:
    """Proportions of languages in each text of a slice, all texts at once."""

    def __init__(self, texts: list[bytes], log_probability: np.ndarray) -> None:
        words = Words(lowered(texts))
        self.counts = words.counts
        self.filled = words.counts > 0
        cells, grams = word_grams(words.vocabulary)
        per_word = np.zeros((len(grams), len(log_probability)), np.float32)
        if len(grams):
            for n, row in enumerate(log_probability):
                per_word[:, n] = np.add.reduceat(row[cells], segment_starts(grams))
        # N-grams of three sizes overlap and say the same thing several times.
        per_word /= len(SIZES)
        self.best = per_word.max(axis=1, initial=-np.inf)
        likelihood = np.exp(per_word - self.best[:, None])
        self.likelihood, self.level = likelihood[words.ids], self.best[words.ids]
        self.starts = segment_starts(words.counts)[self.filled]

    def fit(self, texts: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of some texts (numbers among the filled ones), from `start`."""
        sizes = self.counts[self.filled][texts]
        first = segment_starts(sizes)
        rows = np.repeat(self.starts[texts] - first, sizes) + np.arange(sizes.sum())
        likelihood, share = self.likelihood[rows], start.astype(np.float32)
        owner = np.repeat(np.arange(len(texts)), sizes)
        for _ in range(rounds):
            weighted = likelihood * share[owner]
            total = weighted.sum(axis=1, keepdims=True)
            share = np.add.reduceat(weighted / np.maximum(total, 1e-30), first) / sizes[:, None].astype(np.float32)
        total = (likelihood * share[owner]).sum(axis=1)
        value = np.add.reduceat((np.log(np.maximum(total, 1e-30)) + self.level[rows]).astype(np.float64), first)
        return share, value

    def selected(self) -> np.ndarray:
        """Proportions over the selected set, one row per filled text."""
        n, languages = int(self.filled.sum()), self.likelihood.shape[1]
        if not n:
            return np.zeros((0, languages), np.float32)
        everyone = np.arange(n)
        full, value = self.fit(everyone, np.full((n, languages), 1 / languages), ROUNDS)
        price = PENALTY / 2 * np.log(self.counts[self.filled] + 1)
        order = np.argsort(-full, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        out = (rank == 0).astype(np.float32)
        _, best = self.fit(everyone, out, 0)
        # Larger sets only where even all languages together could pay for one more.
        open_ = np.flatnonzero(value - best > price)
        for size in range(2, languages + 1):
            if not len(open_):
                break
            start = np.where(rank[open_] < size, np.maximum(full[open_], 1e-6), 0)
            share, value = self.fit(open_, start / start.sum(axis=1, keepdims=True), REFINING)
            gain = value - price[open_] * (size - 1)
            better = gain > best[open_]
            out[open_[better]] = share[better]
            best[open_[better]] = gain[better]
        return out


def with_language(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", name: str = "language"
) -> DataFrame:
    """`docs` with a struct (lang_pred, score, languages, shares), in a new column that is the last one."""
    languages, model = learn(docs, id_column, text, lang)
    kind = T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType())),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES * CELLS numbers

    def make(texts: pa.Array) -> list[pa.Array]:
        raw = encoded(texts)
        predicted, score = ["und"] * len(raw), np.zeros(len(raw))
        chosen: list[list[str]] = [[] for _ in raw]
        shares: list[list[float]] = [[] for _ in raw]
        if languages:
            mixture = Mixture(raw, shared.value)
            found = mixture.selected()
            row = np.cumsum(mixture.filled) - 1
            for n, text_ in enumerate(raw):
                if not LETTER.search(text_.decode()):
                    continue
                p = found[row[n]] if mixture.filled[n] else np.full(len(languages), 1 / len(languages))
                order = [int(k) for k in np.argsort(-p, kind="stable") if p[k] > 0]
                predicted[n], score[n] = languages[order[0]], min(1.0, float(p[order[0]]))
                chosen[n], shares[n] = [languages[k] for k in order], [float(p[k]) for k in order]
        return [pa.StructArray.from_arrays(
            [pa.array(predicted, pa.string()), pa.array(score), pa.array(chosen, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
            names=[f.name for f in kind])]

    return add_columns(docs, text, [T.StructField(free_name(docs, name), kind)], make)


def identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The documents with a language that makes up at least `least_score` of them, with their columns.

    A missing language is filled in with the predicted one.
    """
    found = with_language(docs)
    name = found.columns[-1]
    sure = found.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least_score))
    return sure.withColumn("lang", F.coalesce("lang", f"{name}.lang_pred")).select(docs.columns)

"""Quality rules, and robust multivariate outliers among the documents that pass them.

Per language and source a minimum-covariance-determinant estimate of five transformed statistics tells how
documents of that kind look; one too far away by Mahalanobis distance is rejected. An estimate has several starts:
medians and median deviations, and the best that concentration steps from many random subsets find on a
bounded sample of each group. From every start, concentration steps run over all documents: distances, the three
quarters that are nearest, their mean and covariance. The start with the least determinant goes on until its
determinant is stable. Steps run as grouped sums, so that a group that holds a third of all documents reaches the
reducers as one partial sum per task, and models come to rows by broadcast or, if they are many, by a salted join.

Defined cases: a null or blank text has no words and fails the base rules; null languages and sources
are groups of their own; a group too small for an estimate is judged by that of all documents of its language, and
if these are too few by that of all documents; a table too small for any estimate rejects nothing; repeated rows are
judged alike.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm.frames import add_columns, free_name, settled
from crewledger.llm.words import Words, encoded, mix, window_hashes, word_hashes

BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 20, 30
SPAN = 8

DIMENSIONS = 5
# Share of a group that an estimate rests on.
CORE = 0.75
# Distinct points of a group that starts are sought among (about), random subsets tried, and starts kept besides the medians.
SAMPLE, SUBSETS, KEPT_STARTS = 1500, 60, 2
# Steps of every start over all documents, then most steps of the best one, and the change of its log determinant that ends them.
FIRST_STEPS, MOST_STEPS, STABLE = 2, 12, 0.005
# Models that are broadcast: about 250 bytes each. More are joined by unit and salt.
MOST_BROADCAST, SALTS = 20_000, 32
QUANTILE_STEPS = 4000
# Groups with fewer usable documents get no estimate of their own.
LEAST_GROUP = 60
# Least standard deviation of each transformed statistic, and in these units of any mixture of them: closer differences
# are no sign of bad quality.
# Where no text has symbols, the third one rejects a text from about 4.4 symbols in 100 characters on.
FLOORS = (0.35, 0.08, 0.035, 0.06, 0.12)
# Clean documents beyond the cut-off if the statistics were normal.
TAIL = 1e-6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    words = Words(texts)
    count = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    count["n_words"] = words.counts
    for n, text in enumerate(texts):
        if not words.counts[n]:
            count["n_symbols"][n] = 0
            continue
        count["word_chars"][n] = len(text.translate(None, BLANKS).decode())
        count["n_symbols"][n] = len(text) - len(text.translate(None, SYMBOLS))
        lines = [line for line in text.split(b"\n") if line.strip()]
        count["n_dup_lines"][n] = len(lines) - len(set(lines))
    if len(words.ids) >= SPAN:
        owner = words.text_of()
        windows = window_hashes(word_hashes(words.vocabulary)[words.ids], SPAN)
        at = np.flatnonzero(owner[: len(windows)] == owner[SPAN - 1 :])
        key = mix(windows[at] ^ mix(owner[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        found = np.zeros(len(at), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        edge = np.zeros(len(owner) + 1, np.int64)
        np.add.at(edge, at[found], 1)
        np.add.at(edge, at[found] + SPAN, -1)
        count["n_repeat_words"] = np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=len(texts)).astype(np.int64)
    return count


def with_counts(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """`docs` with a struct of the five counts."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def make(texts: pa.Array) -> list[pa.Array]:
        count = base_counts(encoded(texts))
        return [pa.StructArray.from_arrays([pa.array(count[c]) for c in COUNTS], names=list(COUNTS))]

    return add_columns(docs, text, [T.StructField(name, kind)], make)


def base_failed(c: str) -> Column:
    return F.expr(f"{c}.n_words < {LEAST_WORDS} or 100 * {c}.n_repeat_words > {MOST_REPEATED} * {c}.n_words")


def transformed(c: str) -> list[Column]:
    """Statistics that are roughly normal for ordinary text; null-free, 0 for a text without words."""
    words, chars = f"greatest({c}.n_words, 1)", f"greatest({c}.word_chars, 1)"
    return [F.expr(e) for e in (
        f"ln({words})", f"ln({chars} / {words})", f"sqrt({c}.n_symbols / {chars})",
        f"sqrt({c}.n_dup_lines / {words})", f"sqrt({c}.n_repeat_words / {words})",
    )]


def chi_square(degrees: int, x: float) -> float:
    """Distribution function, by its power series."""
    a, x = degrees / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_point(degrees: int, share: float) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(degrees, middle) < share else (low, middle)
    return low


X = [f"x{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
PARAMETERS = [*[f"m{i}" for i in range(DIMENSIONS)], *[f"p{i}{j}" for i, j in PAIRS]]
MODEL = "unit string, start int, logdet double, " + ", ".join(f"{name} double" for name in PARAMETERS)
MODEL_COLUMNS = ["unit", "start", "logdet", *PARAMETERS]


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the model in m0.. and p00.. (the inverse covariance)."""
    terms = [f"{1 if i == j else 2} * p{i}{j} * (x{i} - m{i}) * (x{j} - m{j})" for i, j in PAIRS]
    return F.expr(" + ".join(terms))


def _floored(covariance: np.ndarray) -> np.ndarray:
    """The covariance with a deviation of at least one floor in every direction, so that it always has an inverse."""
    unit = np.outer(FLOORS, FLOORS)
    values, axes = np.linalg.eigh(covariance / unit)
    return (axes * np.maximum(values, 1.0)) @ axes.T * unit


def _fitted(mean: np.ndarray, covariance: np.ndarray) -> list[float]:
    """Log determinant, mean and inverse of a covariance with floors."""
    covariance = _floored(covariance)
    inverse = np.linalg.inv(covariance)
    return [float(np.linalg.slogdet(covariance)[1]), *mean, *(inverse[i, j] for i, j in PAIRS)]


def concentrated(x: np.ndarray, mean: np.ndarray, covariance: np.ndarray, factor: float) -> tuple[float, np.ndarray, np.ndarray]:
    """One concentration step: the points nearest to (mean, covariance), as (log determinant, mean, covariance)."""
    away = x - mean
    d = np.einsum("ni,ij,nj->n", away, np.linalg.inv(covariance), away)
    core = x[np.argsort(d, kind="stable")[: max(1, math.ceil(CORE * len(x)))]]
    covariance = _floored(np.cov(core.T, bias=True) * factor)
    return float(np.linalg.slogdet(covariance)[1]), core.mean(axis=0), covariance


def best_subsets(x: np.ndarray, factor: float, seed: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The KEPT_STARTS different estimates with the least determinants that random subsets of DIMENSIONS + 1 points lead to."""
    r = np.random.default_rng(seed)
    tried = []
    for _ in range(SUBSETS):
        few = x[r.choice(len(x), DIMENSIONS + 1, replace=False)]
        found = (0.0, few.mean(axis=0), _floored(np.cov(few.T, bias=True)))
        for _ in range(2):
            found = concentrated(x, *found[1:], factor)
        tried.append(found)
    tried.sort(key=lambda f: f[0])
    ends = []
    for found in tried[:10]:
        for _ in range(30):
            before, found = found[0], concentrated(x, *found[1:], factor)
            if abs(before - found[0]) < 1e-9:
                break
        if not any(np.allclose(found[1], e[1], atol=1e-6) for e in ends):
            ends.append(found)
    return sorted(ends, key=lambda f: f[0])[:KEPT_STARTS]


def _starts(spread: DataFrame, sample: DataFrame, factor: float) -> DataFrame:
    """Models of all starts: number 0 from medians, the others from subsets of a unit's sample."""

    def medians(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                centre, deviation = np.array(r.centre, float), 1.4826 * np.array(r.spread, float)
                rows.append([r.unit, 0, *_fitted(centre, np.diag(np.square(deviation)))])
            yield pd.DataFrame(rows, columns=MODEL_COLUMNS)

    def subsets(frame):
        unit, x = frame["unit"].iloc[0], frame[X].sort_values(X).to_numpy(float)
        if len(x) < 2 * DIMENSIONS:  # nearly all rows are equal
            return pd.DataFrame([], columns=MODEL_COLUMNS)
        best = best_subsets(x, factor, zlib.crc32(unit.encode()))
        return pd.DataFrame([[unit, n, *_fitted(f[1], f[2])] for n, f in enumerate(best, 1)], columns=MODEL_COLUMNS)

    return spread.mapInPandas(medians, MODEL).unionByName(sample.groupBy("unit").applyInPandas(subsets, MODEL))


def _moments(groups: DataFrame, factor: float) -> DataFrame:
    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                n = r["n"]
                mean = np.array([r[f"s{i}"] / n for i in range(DIMENSIONS)])
                covariance = np.zeros((DIMENSIONS, DIMENSIONS))
                for i, j in PAIRS:
                    covariance[i, j] = covariance[j, i] = r[f"s{i}{j}"] / n - mean[i] * mean[j]
                rows.append([r["unit"], r["start"], *_fitted(mean, covariance * factor)])
            yield pd.DataFrame(rows, columns=MODEL_COLUMNS)

    return groups.mapInPandas(run, MODEL)


def _with_units(rows: DataFrame, small: DataFrame, count: int, on: list[str]) -> DataFrame:
    """Rows with what `small` says about their unit; it has at most `count` units."""
    if count <= MOST_BROADCAST:
        return rows.join(F.broadcast(small), on)
    return rows.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"])


def _step(rows: DataFrame, model: DataFrame, count: int, factor: float) -> DataFrame:
    """The models after a concentration step over all rows."""
    far = _with_units(rows, model, count, ["unit"]).withColumn("d", distance()).select("unit", "salt", "start", "d", *X)
    limit = far.groupBy("unit", "start").agg(F.percentile_approx("d", CORE, QUANTILE_STEPS).alias("limit"))
    core = _with_units(far, limit, count, ["unit", "start"]).filter("d <= limit")
    return settled(_moments(core.groupBy("unit", "start").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS]), factor))


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))


def estimates(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, unit) of all groups and the model of each unit, from rows (lang, source, x0..) of usable documents."""
    sizes = points.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.min("n").alias("least_n"))
    short = langs.agg(F.max(F.expr(f"lang_n < {LEAST_GROUP}")).alias("any_short"))
    # The length of the language in front tells its end, whatever languages and sources are called.
    language = F.concat_ws(":", F.length("lang").cast("string"), "lang")
    own = F.when(F.col("n") >= LEAST_GROUP, F.concat(language, F.col("source")))
    whole = F.when(F.col("lang_n") >= LEAST_GROUP, language)
    # A document counts for its own group, and for its language and the whole table if a small group falls back to them.
    units = settled(sizes.join(langs, "lang").crossJoin(short).select(
        "lang", "source", F.coalesce(own, whole, F.lit("all")).alias("unit"),
        F.array_compact(F.array(own, F.when(F.col("least_n") < LEAST_GROUP, whole), F.when(F.col("any_short"), F.lit("all")))).alias("counted")))
    rows = settled(points.join(units, ["lang", "source"]).select(
        F.explode("counted").alias("unit"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), *X))
    units = units.drop("counted")
    point = F.xxhash64(*X)
    enough = settled(rows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(point).alias("points"),
        *[F.percentile_approx(x, 0.5, QUANTILE_STEPS).alias(f"c{x}") for x in X]).filter(f"n >= {LEAST_GROUP}"))
    count = enough.count()
    spread = _with_units(rows, enough, count, ["unit"]).groupBy("unit").agg(
        F.array(*[F.max(f"c{x}") for x in X]).alias("centre"),
        F.array(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"c{x}")), 0.5, QUANTILE_STEPS) for x in X]).alias("spread"))
    parts = 1 << 40
    sample = _with_units(rows, enough.select("unit", "points"), count, ["unit"]).filter(
        F.pmod(point, F.lit(parts)) < F.lit(parts) * F.lit(SAMPLE) / F.col("points")).select("unit", *X).distinct()
    # A core of normal data has a smaller covariance than the whole, by this factor.
    factor = CORE / chi_square(DIMENSIONS + 2, chi_square_point(DIMENSIONS, CORE))
    model = settled(_starts(spread, sample, factor))
    for _ in range(FIRST_STEPS):
        model = _step(rows, model, count, factor)
    # One row per unit and start.
    best = F.min_by(F.struct(*MODEL_COLUMNS), F.struct("logdet", "start")).alias("best")
    model = settled(model.groupBy("unit").agg(best).select("best.*"))
    for _ in range(MOST_STEPS):
        before, model = model, _step(rows, model, count, factor)
        change = before.select("unit", F.col("logdet").alias("was")).join(model, "unit").agg(F.max(F.abs(F.col("logdet") - F.col("was"))))
        if (change.first()[0] or 0.0) < STABLE:
            break
    return units, model.drop("start", "logdet")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`docs` with a struct column of the counts, `base_failed`, `distance` and `kept`; its name is the last column's."""
    counted = with_counts(docs.select(F.col(text).alias("text"), _key(lang).alias("lang"), _key(source).alias("source")), "c")
    usable = counted.filter(~base_failed("c")).select("lang", "source", *[e.alias(x) for e, x in zip(transformed("c"), X, strict=True)])
    units, model = estimates(settled(usable))
    name, c, m, v, d, m_lang, m_source = (
        free_name(docs, n) for n in ("judged", "judged_counts", "model", "v", "d", "model_lang", "model_source"))
    models = units.join(model, "unit").select(
        F.col("lang").alias(m_lang), F.col("source").alias(m_source), F.struct(*[c for c in model.columns if c != "unit"]).alias(m))
    rows = with_counts(docs, c, text)
    found = rows.join(models, (_key(lang) == F.col(m_lang)) & (_key(source) == F.col(m_source)), "left")
    point = F.struct(*[e.alias(x) for e, x in zip(transformed(c), X, strict=True)])
    squared = " + ".join(
        f"{1 if i == j else 2} * {m}.p{i}{j} * ({v}.x{i} - {m}.m{i}) * ({v}.x{j} - {m}.m{j})" for i, j in PAIRS)
    found = found.withColumn(v, point).withColumn(d, F.expr(squared))
    limit = chi_square_point(DIMENSIONS, 1 - TAIL)
    failed = base_failed(c)
    verdict = F.struct(
        *[F.col(f"{c}.{k}").alias(k) for k in COUNTS], failed.alias("base_failed"), (~failed & F.coalesce(F.col(d) <= limit, F.lit(True))).alias("kept"),
        F.col(d).alias("distance"))
    return found.select(*[rows[x] for x in docs.columns], verdict.alias(name))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    found = judged(docs)
    return found.filter(f"{found.columns[-1]}.kept").select(docs.columns)

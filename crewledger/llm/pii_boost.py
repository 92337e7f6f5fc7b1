"""Personal data: exact rules, and boosted trees over the proposals of high-recall generators.

The base rules find e-mail addresses, IP addresses, card and phone numbers. Generators propose further spans of
the same kinds in looser forms ("ann at host dot com", a phone number without its plus). Boosted trees score
a proposal by its format and its surroundings. They are trained on every different text: base spans and
looser spellings of them are the positives, other proposals and spoilt spellings the negatives. Equal examples
are one, weighted by the number of texts that have it. Texts are split before examples are made of them: a third is
held out, and on its examples a logistic curve per kind turns scores into probabilities, from which the
kind's threshold follows. Added spans never overlap base spans or each other.

Defined cases: a null text is empty and has no spans; repeated rows have equal spans; without enough examples of a
kind nothing of that kind is added.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewledger.llm.frames import add_columns, free_name, map_slices, reach_package, tidy

KINDS = ("email", "ip", "card", "phone")
# Training sees every different text and all its examples; this number only seeds the hash that holds texts out.
SAMPLE_TEXTS = 20_000
TREES, DEPTH, RATE, LEAST_LEAF = 80, 3, 0.3, 8
# A span is added if it is personal with at least this probability, by a curve on which spans above the threshold keep this precision on
# the examples held out. A kind needs as many of both classes there.
PROBABILITY, PRECISION, LEAST_EXAMPLES = 0.9, 0.995, 10
# One text in this many is held out.
HELD = 3
# Examples a task of a training pass reads at most, if there are more than cores to spread them over.
EXAMPLES_PER_TASK = 2_000_000

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by start, then kind. Every rule takes time linear in the text."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            found.append((start, domain.end(), 0))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = only_digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


# Generators. Repeats are bounded, so that they stay linear.
# Where "at" and "dot" are plain words, both must be: a sentence has the one and a full stop.
NAME, LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{2,63}"
MARKED = rf"\s?(?:@|[(\[{{]at[)\]}}])\s?{LABEL}(?:(?:\.|\s?[(\[{{](?:dot|\.)[)\]}}]\s?){LABEL}){{1,4}}"
SPOKEN = rf"\sat\s{LABEL}(?:\sdot\s{LABEL}){{1,4}}"
GENERATORS = (
    re.compile(rf"{NAME}(?:{MARKED}|{SPOKEN})", re.I),
    re.compile(r"(?<![0-9])[0-9]{1,4}(?:\s?(?:\.|\[\.\]|\(\.\)|-|,)\s?[0-9]{1,4}){3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])"),
    re.compile(r"(?<![0-9+])(?:\+|00)?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}(?![0-9])"),
)
SIGNS = ("@", "(at)", "[at]", "{at}", " dot ", "(dot)", "[dot]", "{dot}")
CONTEXT = (
    ("mail", "contact", "write", "reach"),
    ("ip", "host", "address", "server", "login"),
    ("card", "visa", "master", "credit", "pay"),
    ("phone", "tel", "call", "fax", "mobile", "sms"),
)


def proposals(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    found: list[Span] = []
    if any(s in text for s in SIGNS) or any(s in text.lower() for s in SIGNS[1:]):
        found += [(m.start(), m.end(), 0) for m in GENERATORS[0].finditer(text)]
    if DIGIT.search(text):
        for kind in (1, 2, 3):
            found += [(m.start(), m.end(), kind) for m in GENERATORS[kind].finditer(text)]
    return found


def around(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2


FEATURES, CHECKED, ANNOUNCED = 22, 11, 19
# Country codes of one to three digits, for made-up spellings.
COUNTRIES = ("1", "44", "49", "353")


def features(text: str, span: Span) -> list[int]:
    """Small whole numbers that describe the format of a proposal and its surroundings."""
    start, end, kind = span
    s = text[start:end]
    low, digits = s.lower(), only_digits(s)
    groups = re.findall(r"[0-9]+", s)
    parts = [int(g[:9]) for g in groups]
    labels = re.findall(r"[a-z0-9-]+", low)
    before = text[max(0, start - 24) : start].lower()
    return [
        kind, min(31, len(digits)), min(31, sum(c.isalpha() for c in s)), min(15, sum(c in " .-/_,()[]{}" for c in s)),
        min(15, len(groups)), min(15, len(groups[0]) if groups else 0), min(20, max(map(len, groups), default=0)),
        min(15, len(groups[-1]) if groups else 0), int(s.startswith("+")), int(s.startswith("00")), int("(" in s and ")" in s),
        int(len(digits) >= 12 and luhn(digits)), int(len(parts) == 4 and max(parts) <= 255),
        2 if "@" in s else 1 if any(x in low for x in SIGNS[1:4]) else 0,
        int(any(x in low for x in SIGNS[5:])) + 2 * int(" dot " in low),
        min(15, len(labels[-1])) if labels and labels[-1].isalpha() else 0, min(15, len(labels)),
        around(text[start - 1 : start]), around(text[end : end + 1]),
        int(any(w in before for w in CONTEXT[kind])), min(10, len(set(digits))), min(63, len(s)),
    ]


def spellings(s: str, kind: int) -> tuple[list[str], list[str]]:
    """Looser spellings of a base span that mean the same, and spoilt ones that mean nothing."""
    digits = only_digits(s)
    if kind == 0:
        name, host = s.rsplit("@", 1)
        dotted = host.split(".")
        plain = "".join(c for c in name if c.isalpha()) or name  # digits in a name are no sign of an address
        forms = [(f"{n} at {' dot '.join(dotted)}", f"{n} [at] {' [dot] '.join(dotted)}", f"{n}(at){'(dot)'.join(dotted)}", f"{n} @ {host}")
                 for n in dict.fromkeys((name, plain))]
        return (
            [w for form in forms for w in form],
            [f"{name} at {dotted[0]}. {dotted[-1]}", f"@{host}", f"{name} dot {host}"],
        )
    if kind == 1:
        parts = s.split(".")
        return (
            ["[.]".join(parts), "(.)".join(parts), " . ".join(parts)],
            [".".join([str(int(p) % 256 + 300) for p in parts]), "-".join(parts), ", ".join(parts), ".".join(parts[:3])],
        )
    if kind == 2:
        spoilt = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        four = [digits[n : n + 4] for n in range(0, len(digits), 4)]
        wrong = [spoilt, ".".join([*four[:-1], spoilt[-len(four[-1]):]]), digits[:11], spoilt + "7"]
        # By chance a spoilt number may pass the check again: it is no example of either class.
        return [".".join(four), "/".join(four), "  ".join(four)], [w for w in wrong if not luhn(only_digits(w))]
    ten = digits[-10:]
    return (
        [f"({ten[:3]}) {ten[3:6]}-{ten[6:]}", f"00{digits[:-10] or 1} {ten[:3]} {ten[3:6]} {ten[6:]}", f"{ten[:3]}-{ten[3:6]}-{ten[6:]}",
         f"00{COUNTRIES[int(ten[-1]) % len(COUNTRIES)]} {ten[:2]} {ten[2:6]} {ten[6:]}"],
        [ten, ten[:7], f"{ten[:4]}-{ten[4:6]}-{ten[6:8]}", f"{ten[:2]}.{ten[2:4]}.{ten[4:8]}", f"{ten[:6]} {ten[6:]}"],
    )


def overlaps(a: Span, b: Span) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def examples(text: str) -> list[list[int]]:
    """Features and label (last) of the proposals in a text and in respelt copies of its base spans."""
    base, out = base_spans(text), []
    near = proposals(text)
    for p in near:
        found = features(text, p)
        # Loose addresses, numbers that their surroundings announce and card numbers that pass the check may well be personal: no
        # example of either class.
        likely = found[ANNOUNCED] or (p[2] == 2 and found[CHECKED])
        if p[2] and not likely and not any(overlaps(p, b) for b in base):
            out.append([*found, 0])
    for b in base:
        out += [[*features(text, p), int(p[2] == b[2])] for p in near if p[:2] == b[:2]]
        left, right = text[max(0, b[0] - 40) : b[0]], text[b[1] : b[1] + 40]
        good, spoilt = spellings(text[b[0] : b[1]], b[2])
        words = re.findall(r"[^\W\d_]+", left + " " + right)
        if b[2] == 0 and len(words) > 2:  # a sentence that only sounds like an address
            spoilt.append(f"{words[0]} at {words[1]} dot {words[2]}")
        for label, words in ((1, good), (0, spoilt)):
            for w in words:
                snippet, inner = left + w + right, (len(left), len(left) + len(w), b[2])
                for p in proposals(snippet):
                    if p[:2] == inner[:2]:
                        out.append([*features(snippet, p), label if p[2] == b[2] else 0])
                    elif overlaps(p, inner):
                        out.append([*features(snippet, p), 0])
    return out


@dataclass
class Model:
    """Trees as arrays by node: feature (-1: leaf), limit, value; children of n are 2n + 1 (at most limit) and 2n + 2."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    thresholds: tuple[float, ...] = (np.inf,) * len(KINDS)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > limit[node]), node)
            total += value[node]
        return total


def grow(x: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of second-order boosting over weighted rows; features are whole numbers below 64."""
    size = 2 ** (DEPTH + 1) - 1
    feature, limit, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
    members = {0: np.arange(len(x))}
    for node in range(size):
        rows = members.pop(node, None)
        if rows is None:
            continue
        g, h = gradient[rows], curvature[rows]
        value[node] = -RATE * g.sum() / (h.sum() + 1.0)
        if 2 * node + 2 >= size or weight[rows].sum() < 2 * LEAST_LEAF:
            continue
        best = (1e-6, -1, 0)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]):
            gs, hs, ns = (np.bincount(x[rows, f], weights=w, minlength=64).cumsum() for w in (g, h, weight[rows]))
            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
            gain[(ns < LEAST_LEAF) | (ns[-1] - ns < LEAST_LEAF)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        if best[1] >= 0:
            feature[node], limit[node] = best[1], best[2]
            right = x[rows, best[1]] > best[2]
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return feature, limit, value


def curve(score: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to probabilities, with targets drawn in by one example of either class."""
    good, bad = (weight * truth).sum(), (weight * (1 - truth)).sum()
    target = np.where(truth > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0

    def loss(slope: float, shift: float) -> float:
        z = slope * score + shift
        return float((weight * (np.logaddexp(0, z) - target * z)).sum()) + 1e-6 * (slope**2 + shift**2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -50, 50)))
        off, bend = weight * (p - target), weight * p * (1 - p)
        down = np.array([(off * score).sum() + 2e-6 * slope, off.sum() + 2e-6 * shift])
        square = np.array([[(bend * score**2).sum(), (bend * score).sum()], [(bend * score).sum(), bend.sum()]]) + 2e-6 * np.eye(2)
        step, length = np.linalg.solve(square, down), 1.0
        while length > 1e-6 and loss(slope - length * step[0], shift - length * step[1]) > loss(slope, shift):
            length /= 2
        slope, shift = slope - length * step[0], shift - length * step[1]
        if np.abs(length * step).max() < 1e-9:
            break
    return float(slope), float(shift)


def threshold(score: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """Least score to add a span at: probable enough by the curve, and precise enough among the examples above it."""
    if (weight * truth).sum() < LEAST_EXAMPLES or (weight * (1 - truth)).sum() < LEAST_EXAMPLES:
        return np.inf
    slope, shift = curve(score, truth, weight)
    if slope <= 0:
        return np.inf
    least = (np.log(PROBABILITY / (1 - PROBABILITY)) - shift) / slope
    above = score >= least
    order = np.argsort(-score[above], kind="stable")
    s, right, n = score[above][order], (weight * truth)[above][order], weight[above][order]
    fits = (np.cumsum(right) >= PRECISION * np.cumsum(n)) & (np.append(s[1:], -np.inf) < s)
    if not len(s) or fits[-1]:
        return float(least)
    ends = np.flatnonzero(fits)
    return float(s[ends[-1]]) if len(ends) else np.inf


def train(rows: np.ndarray, weight: np.ndarray, held: np.ndarray) -> Model:
    """Boosted trees from the weighted examples (features, label) that are not held out, and thresholds from those that are."""
    model = Model()
    if not len(rows) or weight[~held].sum() < 2 * LEAST_EXAMPLES:
        return model
    order = np.lexsort([*rows.T, held])  # the order of arrival does not matter
    rows, weight, held = rows[order], weight[order].astype(float), held[order]
    x, y = rows[:, :-1], rows[:, -1].astype(float)
    fit, label, share = x[~held], y[~held], weight[~held]
    score = np.zeros(len(fit))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(fit, share * (p - label), share * p * (1 - p), share)
        model.trees.append(tree)
        score = model.score(fit)
    mine = [held & (x[:, 0] == kind) for kind in range(len(KINDS))]
    model.thresholds = tuple(threshold(model.score(x[m]), y[m], weight[m]) for m in mine)
    return model


def sampled_examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(example, held, n): the different examples of every different text, and how many texts have each."""
    key = F.xxhash64(F.lit(SAMPLE_TEXTS), "text")
    texts = docs.select(F.col(text).alias("text")).filter("text is not null")
    # Copies meet as one text per task, whatever their number.
    every = texts.withColumn("key", key).groupBy("key").agg(F.first("text").alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [(k, e) for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for e in sorted({bytes(e) for e in examples(t)})]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([e for _, e in rows], pa.binary())],
                                          names=["key", "example"]) if rows else None

    found = map_slices(every, "text", "key long, example binary", make)
    held = F.pmod(F.xxhash64(F.lit("held"), "key"), F.lit(HELD)) == 0
    return found.groupBy("example", held.alias("held")).agg(F.count(F.lit(1)).alias("n"))


def decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of a batch of (example, n)."""
    rows = np.frombuffer(b"".join(batch.column("example").to_pylist()), np.uint8).reshape(-1, FEATURES + 1).astype(np.int64)
    return rows[:, :-1], rows[:, -1].astype(float), batch.column("n").to_numpy().astype(float)


def spread_tree(fit: DataFrame, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next tree of grow() over the examples of `fit`: each level's sums by node, feature and value are added up in tasks."""
    size = 2 ** (DEPTH + 1) - 1
    feature, limit, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
    known: dict[int, tuple[float, float, float]] = {}  # node: sums of gradient, curvature and weight
    for level in range(DEPTH):
        first = 2**level - 1
        if level and not any(first <= n < 2 * first + 1 for n in known):
            break
        partial = (feature.copy(), limit.copy())

        def sums(batches, level=level, first=first, partial=partial):
            total = np.zeros((first + 1, FEATURES, 3, 64))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, w = decoded(batch)
                p = 1 / (1 + np.exp(-Model(trees).score(x)))
                g, h = w * (p - y), w * p * (1 - p)
                node, live = np.zeros(len(x), np.int64), np.ones(len(x), bool)
                for _ in range(level):
                    f = partial[0][node]
                    live &= f >= 0
                    node = np.where(live, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > partial[1][node]), node)
                place = node[live] - first
                for f in range(FEATURES):
                    at = place * 64 + x[live, f]
                    for k, v in enumerate((g, h, w)):
                        total[:, f, k] += np.bincount(at, v[live], minlength=(first + 1) * 64).reshape(first + 1, 64)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        found = fit.mapInArrow(tidy(sums), "sums binary").collect()
        hist = sum((np.frombuffer(r["sums"], np.float64).reshape(first + 1, FEATURES, 3, 64) for r in found), np.zeros((first + 1, FEATURES, 3, 64)))
        for node in range(first, 2 * first + 1):
            if level and node not in known:
                continue
            gs, hs, ns = (hist[node - first, :, k].cumsum(axis=1) for k in range(3))
            if not level:
                if not ns[0, -1]:
                    return feature, limit, value
                known[0] = (gs[0, -1], hs[0, -1], ns[0, -1])
            g, h, n = known[node]
            value[node] = -RATE * g / (h + 1.0)
            if n < 2 * LEAST_LEAF:
                continue
            best = (1e-6, -1, 0)
            whole = g**2 / (h + 1.0)
            for f in range(FEATURES):
                gain = gs[f] ** 2 / (hs[f] + 1) + (gs[f, -1] - gs[f]) ** 2 / (hs[f, -1] - hs[f] + 1) - whole
                gain[(ns[f] < LEAST_LEAF) | (ns[f, -1] - ns[f] < LEAST_LEAF)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
            if best[1] >= 0:
                f, at = best[1], best[2]
                feature[node], limit[node] = f, at
                known[2 * node + 1] = (gs[f, at], hs[f, at], ns[f, at])
                known[2 * node + 2] = (g - gs[f, at], h - hs[f, at], n - ns[f, at])
    for node in range(2**DEPTH - 1, size):
        if node in known:
            value[node] = -RATE * known[node][0] / (known[node][1] + 1.0)
    return feature, limit, value


def learn(docs: DataFrame, text: str = "text") -> Model:
    """A model from the examples of every text: trees grown level by level from sums made in tasks, thresholds from the
    held-out examples summed by kind, score and label. The driver gets sums, never the examples."""
    reach_package(docs.sparkSession)
    found = sampled_examples(docs, text).persist()
    try:
        model = Model()
        counts = found.groupBy("held").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        weights = {r["held"]: r["n"] for r in counts}
        if weights.get(False, 0) < 2 * LEAST_EXAMPLES:
            return model
        # Each of the TREES * DEPTH passes reads every example, in as many tasks as cores or bounded slices of examples need, not
        # one per shuffle partition: the driver keeps an account of every task of every pass.
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sum(r["rows"] for r in counts) // EXAMPLES_PER_TASK))
        fit, held = found.filter(~F.col("held")).coalesce(tasks), found.filter(F.col("held")).coalesce(tasks)
        for _ in range(TREES):
            model.trees.append(spread_tree(fit, model.trees))
        trees = model.trees

        def scored(batches):
            for batch in batches:
                if batch.num_rows:
                    x, y, w = decoded(batch)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(Model(trees).score(x)), pa.array(y), pa.array(w)],
                                                     names=["kind", "score", "truth", "n"])

        sums = (held.mapInArrow(tidy(scored), "kind long, score double, truth double, n double")
                .groupBy("kind", "score", "truth").agg(F.sum("n").alias("n")).orderBy("kind", "score", "truth").toArrow())
        kind, score, truth, n = (sums.column(c).to_numpy() for c in ("kind", "score", "truth", "n"))
        model.thresholds = tuple(threshold(score[kind == k], truth[kind == k], n[kind == k]) for k in range(len(KINDS)))
        return model
    finally:
        found.unpersist()


def spans_of(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and added ones, by start, then kind."""
    base = base_spans(text)
    spare = [p for p in proposals(text) if not any(overlaps(p, b) for b in base)]
    if not spare:
        return base, base
    score = model.score(np.array([features(text, p) for p in spare], np.int64))
    added: list[Span] = []
    for n in sorted(range(len(spare)), key=lambda n: (-score[n], spare[n])):
        if score[n] >= model.thresholds[spare[n][2]] and not any(overlaps(spare[n], a) for a in added):
            added.append(spare[n])
    return base, sorted(base + added, key=lambda s: (s[0], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def with_spans(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """`docs` with a struct (base, spans, redacted) in a new last column; redacted has a mark for every span."""
    model = model or learn(docs, text)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    kind = T.StructType([T.StructField("base", span), T.StructField("spans", span), T.StructField("redacted", T.StringType())])
    row = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def make(texts: pa.Array) -> list[pa.Array]:
        base, every, clean = [], [], []
        for value in texts.to_pylist():
            b, a = spans_of(value or "", model)
            base.append([(KINDS[k], s, e) for s, e, k in b])
            every.append([(KINDS[k], s, e) for s, e, k in a])
            clean.append(redact(value, a) if a else value)
        return [pa.StructArray.from_arrays([pa.array(base, pa.list_(row)), pa.array(every, pa.list_(row)), pa.array(clean, pa.string())],
                                           names=["base", "spans", "redacted"])]

    return add_columns(docs, text, [T.StructField(free_name(docs, "pii"), kind)], make)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark of its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Numbers of base spans per kind, the digest of the base spans, and all spans, per document."""
    model = learn(docs, text)
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
        sha, spans = [], []
        for n, value in enumerate(batch.column("text").to_pylist()):
            base, every = spans_of(value or "", model)
            for _, _, k in base:
                counts[n, k] += 1
            sha.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c) for c in counts.T.copy()], pa.array(sha), pa.array(spans)],
            names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_slices(rows, "text", schema, make)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in `text`, and `n_chars` counted anew."""
    found = with_spans(docs)
    name = found.columns[-1]
    found = found.withColumn("text", F.col(f"{name}.redacted"))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)

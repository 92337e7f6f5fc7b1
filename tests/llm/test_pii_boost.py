"""Training of the personal-data model: trees, curve, thresholds and examples against plain versions."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from crewledger.llm import pii_boost


def plain_tree(rows, depth=pii_boost.DEPTH):
    """Nested (feature, limit, left, right) or a value, from (x, gradient, curvature, weight), every split tried."""

    def part(chosen):
        return sum(r[1] for r in chosen) ** 2 / (sum(r[2] for r in chosen) + 1)

    value = -pii_boost.RATE * sum(r[1] for r in rows) / (sum(r[2] for r in rows) + 1)
    best = (1e-6, None)
    if depth and sum(r[3] for r in rows) >= 2 * pii_boost.LEAST_LEAF:
        for f in range(len(rows[0][0])):
            for limit in range(64):
                left, right = [r for r in rows if r[0][f] <= limit], [r for r in rows if r[0][f] > limit]
                if min(sum(r[3] for r in left), sum(r[3] for r in right)) < pii_boost.LEAST_LEAF:
                    continue
                gain = part(left) + part(right) - part(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, limit, left, right))
    if best[1] is None:
        return value
    f, limit, left, right = best[1]
    return f, limit, plain_tree(left, depth - 1), plain_tree(right, depth - 1)


def answer(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_against_every_split(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (70, 4))
    g, h, w = r.normal(0, 2, 70), r.uniform(0.1, 1, 70), r.integers(1, 6, 70).astype(float)
    tree = plain_tree(list(zip(x.tolist(), g, h, w, strict=True)))
    model = pii_boost.Model([pii_boost.grow(x, g, h, w)])
    assert np.allclose(model.score(x), [answer(tree, row) for row in x.tolist()])


def test_weights_stand_for_repeated_rows():
    r = np.random.default_rng(4)
    x, g, h, w = r.integers(0, 12, (60, 4)), r.normal(0, 2, 60), r.uniform(0.1, 1, 60), r.integers(1, 5, 60)
    once = pii_boost.Model([pii_boost.grow(x, g * w, h * w, w.astype(float))])
    often = pii_boost.Model([pii_boost.grow(np.repeat(x, w, axis=0), np.repeat(g, w), np.repeat(h, w), np.ones(w.sum()))])
    assert np.allclose(once.score(x), often.score(x))


def test_curve_is_the_likeliest_one():
    r = np.random.default_rng(5)
    score = r.normal(0, 2, 300)
    truth, weight = (r.random(300) < 1 / (1 + np.exp(-1.5 * score + 0.5))).astype(float), r.integers(1, 4, 300).astype(float)
    slope, shift = pii_boost.curve(score, truth, weight)
    good, bad = (weight * truth).sum(), (weight * (1 - truth)).sum()
    target = np.where(truth > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(a, b):
        return sum(w * (math.log1p(math.exp(a * s + b)) - t * (a * s + b)) for s, t, w in zip(score, target, weight, strict=True))

    least = loss(slope, shift)
    assert all(loss(slope + a, shift + b) >= least for a in (-0.02, 0, 0.02) for b in (-0.02, 0, 0.02))
    assert 1.1 < slope < 2.0


def test_thresholds_follow_the_data():
    r = np.random.default_rng(6)
    truth = np.repeat([0.0, 1.0], 500)
    apart = pii_boost.threshold(truth * 8 - 4 + r.normal(0, 0.3, 1000), truth, np.ones(1000))
    assert -3 < apart < 3
    score = truth * 3 + r.normal(0, 1, 1000)
    mixed = pii_boost.threshold(score, truth, np.ones(1000))
    assert truth[score >= mixed].mean() >= pii_boost.PRECISION and (score[truth == 1] >= mixed).any()
    assert abs(pii_boost.threshold(score + 5, truth, np.ones(1000)) - mixed - 5) < 1e-6  # no fixed floor
    assert pii_boost.threshold(-score, truth, np.ones(1000)) == np.inf
    assert pii_boost.threshold(score, np.ones(1000), np.ones(1000)) == np.inf


def texts():
    r = random.Random(7)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(80)]

    def text():
        parts = [r.choice(words) for _ in range(30)]
        parts[r.randrange(10, 20)] = r.choice([
            f"{r.choice(words)}{r.randrange(99)}@{r.choice(words)}.example.com", ".".join(str(r.randrange(1, 255)) for _ in range(4)),
            f"+{r.choice(['1', '44'])} {r.randrange(200, 999)} 555 {r.randrange(1000, 9999)}"])
        return " ".join(parts)

    return [text() for _ in range(600)]


def test_examples_are_counted_by_text_and_split_by_text(spark):
    some = texts()[:60]
    frame = spark.createDataFrame([(t,) for t in some + [some[0]] * 500 + [None, ""]], "text string")
    found = pii_boost.sampled_examples(frame).collect()
    per_text = {t: {bytes(e) for e in pii_boost.examples(t)} for t in some}
    wanted = collections.Counter(e for t in per_text.values() for e in t)
    got = collections.Counter()
    for r in found:
        got[bytes(r["example"])] += r["n"]
    assert got == wanted
    alone = {e: t for t, es in per_text.items() for e in es if wanted[e] == 1}
    sides = collections.defaultdict(set)
    for r in found:
        if bytes(r["example"]) in alone:
            sides[alone[bytes(r["example"])]].add(r["held"])
    assert all(len(s) == 1 for s in sides.values()) and {s for side in sides.values() for s in side} == {True, False}


def test_model_does_not_depend_on_copies_and_its_examples_are_bounded(spark, monkeypatch):
    some = texts()
    plain = pii_boost.learn(spark.createDataFrame([(t,) for t in some], "text string"))
    copies = pii_boost.learn(spark.createDataFrame([(t,) for t in some[::-1] + some[:1] * 400], "text string"))
    assert plain.thresholds == copies.thresholds and all(np.isfinite(plain.thresholds[k]) for k in (0, 1, 3))
    seen = []
    monkeypatch.setattr(pii_boost, "MOST_EXAMPLES", 50)
    monkeypatch.setattr(pii_boost, "train", lambda rows, weight, held: seen.append((len(rows), len(weight), len(held))))
    pii_boost.learn(spark.createDataFrame([(t,) for t in some], "text string"))
    assert seen == [(50, 50, 50)]


def test_spoken_and_international_forms_are_found(spark):
    model = pii_boost.learn(spark.createDataFrame([(t,) for t in texts()], "text string"))

    def added(text):
        return [(pii_boost.KINDS[k], text[a:b]) for a, b, k in pii_boost.spans_of(text, model)[1]]

    assert added("write to ann (at) host (dot) com soon") == [("email", "ann (at) host (dot) com")]
    assert added("phone 0044 20 7946 0958 at night") == [("phone", "0044 20 7946 0958")]
    assert added("server 10[.]20[.]30[.]40 is down") == [("ip", "10[.]20[.]30[.]40")]
    for clean in ("pages 120-130 of 1914 1918", "version 1-2-3-4 of the form", "in 2020 2021 and 2022", "it was at home. Then"):
        assert added(clean) == [], clean


def test_every_text_is_learnt_from_and_trees_match_the_plain_ones(spark, monkeypatch):
    some = texts()[:120]
    monkeypatch.setattr(pii_boost, "SAMPLE_TEXTS", 10)  # once a bound on the texts drawn; now only a seed
    frame = spark.createDataFrame([(t,) for t in some], "text string")
    found = pii_boost.sampled_examples(frame).collect()
    got = collections.Counter()
    for r in found:
        got[bytes(r["example"])] += r["n"]
    assert got == collections.Counter(e for t in set(some) for e in {bytes(e) for e in pii_boost.examples(t)})
    monkeypatch.setattr(pii_boost, "TREES", 3)
    model = pii_boost.learn(frame)
    rows = np.array([list(r["example"]) for r in found], np.int64)
    plain = pii_boost.train(rows, np.array([r["n"] for r in found]), np.array([r["held"] for r in found]))
    assert len(model.trees) == len(plain.trees) == 3
    assert np.allclose(model.score(rows[:, :-1]), plain.score(rows[:, :-1]))


def test_training_passes_take_tasks_by_cores_not_by_shuffle_partitions(spark, monkeypatch):
    monkeypatch.setattr(pii_boost, "TREES", 4)
    frame = spark.createDataFrame([(t,) for t in texts()[:200]], "text string")
    sc, before = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sc.setJobGroup("pii-passes", "training passes")
    try:
        pii_boost.learn(frame)
    finally:
        sc.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = [s for j in sc.statusTracker().getJobIdsForGroup("pii-passes") for s in sc.statusTracker().getJobInfo(j).stageIds]
    wide = [s for s in set(stages) if (info := sc.statusTracker().getStageInfo(s)) and info.numCompletedTasks > sc.defaultParallelism]
    assert len(wide) < pii_boost.TREES * pii_boost.DEPTH, len(wide)  # the passes are not among them

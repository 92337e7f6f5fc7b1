"""The corpus operators against brute force, on small tables that hold the awkward cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crewledger.llm import (
    components as cc, edit_embedding, external_shuffle, language_em, minhash_bbit, pack_reduction, pii_boost, quality_mcd, queries,
    separator_scan, tokens, tree_bpe, url_rules,
)
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, `ids` string, shard string"


def awkward() -> list[tuple]:
    """Nulls, empty, blank and very long texts, copies, near copies, repeated rows, and columns with clashing names."""
    r = random.Random(5)
    vocabulary = {lang: ["".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(300)]
                  for lang, letters in (("en", "etaoinshr"), ("de", "üßöäzkcnu"), ("fr", "éèçàquelx"))}

    def prose(lang, n):
        return " ".join(r.choice(vocabulary[lang]) for _ in range(n))

    rows = []
    for n in range(160):
        lang = r.choice(["en", "en", "en", "de", "fr"])
        rows.append((n, prose(lang, r.randrange(25, 200)), lang, r.choice(["a", "a", "b"])))
    base = rows[3][1].split()
    near = base.copy()
    near[len(near) // 2] = "changed"
    texts = [None, "", " \n\t ", "one two", "One TWO", "a b c d e", rows[0][1], rows[0][1], " ".join(near) + " tail", "12 34 %% 77",
             prose("en", 9000), "x" * 30_000, "\n".join(["same line of words here"] * 30), "mail ann@host.example.com ip 10.0.0.1 end",
             "漢字かな交じり文", "é" * 50 + " " + prose("de", 40), "<|endoftext|> a<|endoftext|>b"]
    for n, text in enumerate(texts, 200):
        rows.append((n, text, None if n % 3 else "en", None if n % 2 else "a"))
    rows += [rows[5], rows[5], (None, "no id " + prose("en", 30), "en", "a"), (7, "another text of id seven", None, None)]
    return [(*row, None, 1, "k", "i", "s") for row in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ── components, near-duplicates ──────────────────────────────────────────────────────────────


def reach(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(label[u], label[v])
            changed |= label[u] != low or label[v] != low
            label[u] = label[v] = low
    return label


@pytest.mark.parametrize("kind", ["path", "reversed path", "random", "star", "none"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {"path": [(n, n + 1) for n in range(60)], "reversed path": [(100 - n, 99 - n) for n in range(50)],
             "random": [(r.randrange(80), r.randrange(80)) for _ in range(70)], "star": [(5, n) for n in range(6, 90)], "none": []}[kind]
    found = cc.components(spark.createDataFrame(edges, "u long, v long"))
    wanted = reach([e for e in edges if e[0] != e[1]])
    assert {row["node"]: row["label"] for row in found.collect()} == wanted


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[n : n + 5]) for n in range(len(words) - 4)}


def test_near_duplicates_against_all_pairs(docs, rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2)
             if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y)]
    label = reach(edges)
    wanted = collections.Counter((n, len(s), label.get(n, n)) for n, s in sets)
    found = minhash_bbit.near_duplicates(docs)
    assert collections.Counter(map(tuple, found.collect())) == wanted


def near_group(count, base_words, most_edits, seed):
    """Texts that differ from one base in up to `most_edits` words: alike, but often below the limit."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(base_words)]
    texts = []
    for _ in range(count):
        words = list(base)
        for place in rng.sample(range(base_words), rng.randint(0, most_edits)):
            words[place] = f"x{rng.randint(0, 10**9)}"
        texts.append(" ".join(words))
    return texts


def test_near_duplicates_of_a_loose_group_in_many_blocks(spark, monkeypatch):
    """Members between and above the limit, dealt into blocks of eight: the same components as all pairs."""
    monkeypatch.setattr(minhash_bbit, "BLOCK_ROWS", 8)
    texts = near_group(120, 150, 6, 11)
    sets = [shingles(t) for t in texts]
    label = reach([(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
                   if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    expected = {n: label.get(n, n) for n in range(len(texts))}
    assert 1 < len(set(expected.values())) < len(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row["id"]: row["component_id"] for row in minhash_bbit.near_duplicates(frame).collect()}
    assert found == expected


def test_spanning_links_connect_what_all_links_connect():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(2, 40))
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        sets = []
        for _ in range(n):
            x = base.copy()
            edits = int(rng.integers(0, 10))
            x[rng.integers(0, 60, edits)] = rng.integers(0, 1 << 60, edits, dtype=np.uint64)
            sets.append(np.unique(x))
        label = rng.integers(0, max(1, n - 3), n)

        def linked(a, b):
            shared = len(np.intersect1d(a, b))
            return 100 * shared >= 85 * (len(a) + len(b) - shared)

        pairs = list(itertools.combinations(range(n), 2))
        same = [(i, j) for i, j in pairs if label[i] == label[j]]
        found = minhash_bbit.spanning_links(label, sets, 85)
        assert len(found) < n and all(linked(sets[i], sets[j]) for i, j in found)
        assert reach(same + found) == reach(same + [(i, j) for i, j in pairs if linked(sets[i], sets[j])])


def test_near_duplicate_chain_in_one_bucket(spark):
    """Members of a bucket that its smallest one does not reach are linked to each other."""
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words[n : n + 200]) for n in range(0, 200, 8)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    edges = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = reach(edges)
    found = {row["id"]: row["component_id"] for row in minhash_bbit.near_duplicates(frame).collect()}
    assert found == {n: label.get(n, n) for n in range(len(texts))}


def test_estimates_follow_similarity(spark):
    r = random.Random(2)
    words = [f"w{n}" for n in range(900)]
    for share in (0.2, 0.5, 0.85):
        common = int(800 * share / (1 + share))
        a, b = words[:400], words[400 - common : 800 - common]
        r.shuffle(a), r.shuffle(b)
        value = [np.sort(np.array([hash(w) % 2**63 for w in x], np.uint64)) for x in (a, b)]
        lanes = minhash_bbit.packed(minhash_bbit.signatures(np.concatenate(value), np.array([400, 400]), 128)).view(np.int64)
        frame = spark.createDataFrame([(lanes[0].tolist(), lanes[1].tolist())], "a array<long>, b array<long>")
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(frame.select(minhash_bbit.estimate("a", "b")).first()[0] - true) < 0.2


def test_stage_drops_copies_between_eighty_and_eighty_five(spark):
    """Pairs at about 0.82 go through the stage as one text, those at about 0.77 as two; op9 keeps both at 85."""
    r = random.Random(8)
    texts = []
    for pair in range(60):
        words = [f"w{r.randrange(10**9)}" for _ in range(104)]
        # Of 100 shingles each, a changed end of n words leaves 100 - n: 91 / 109 = 0.83 and 87 / 113 = 0.77.
        other = words[:-9] + [f"x{r.randrange(10**9)}" for _ in range(9)] if pair < 40 else words[:-13] + [f"x{r.randrange(10**9)}" for _ in range(13)]
        texts += [" ".join(words), " ".join(other)]
    alike = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert all(0.8 <= x < 0.85 for x in alike[:40]) and all(x < 0.8 for x in alike[40:])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {row["doc_id"] for row in corpus_pipeline.near_dedup(spark, frame, FOLDER).collect()}
    assert kept == set(range(120)) - set(range(1, 80, 2))
    assert minhash_bbit.deduplicated(frame).count() == 120


def test_bands_and_slack_follow_the_limit():
    assert minhash_bbit.banding(85) == (32, 6) and abs(minhash_bbit.slack(85) - 6 * 0.033) < 1e-9
    for percent in (50, 70, 80, 85, 90, 99):
        bands, rows = minhash_bbit.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 2.7e-7
    assert minhash_bbit.slack(80) > minhash_bbit.slack(85) > minhash_bbit.slack(95)


def test_deduplicated_keeps_one_of_each_group(docs, rows):
    found = minhash_bbit.deduplicated(docs)
    assert found.columns == docs.columns
    ids = [r["doc_id"] for r in found.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 0 in ids and 206 not in ids and 203 in ids and 204 not in ids


# ── quality ──────────────────────────────────────────────────────────────────────────────────


def counts(text):
    words, text = WORD.findall(text or ""), text or ""
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = collections.defaultdict(list)
    for n in range(len(words) - 7):
        windows[tuple(words[n : n + 8])].append(n)
    covered = {n + k for places in windows.values() if len(places) > 1 for n in places for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)) if words else 0, len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_rules(docs, rows):
    found = quality_mcd.judged(docs)
    name = found.columns[-1]
    got = collections.Counter((r["doc_id"], *[r[name][c] for c in quality_mcd.COUNTS], r[name]["base_failed"]) for r in found.collect())
    wanted = collections.Counter()
    for row in rows:
        c = counts(row[1])
        wanted[(row[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert got == wanted
    assert all(not r[name]["kept"] for r in found.collect() if r[name]["base_failed"])


def test_outliers_go_and_ordinary_text_stays(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    clean = [(n, " ".join(r.choice(vocabulary) for _ in range(r.randrange(40, 400))), "en", f"s{n % 2}") for n in range(300)]
    bad = [(1000 + n, " ".join(w + "%%#" for w in r.sample(vocabulary, 100)), "en", f"s{n % 2}") for n in range(40)]
    frame = spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")
    ids = {row["doc_id"] for row in quality_mcd.kept(frame).select("doc_id").collect()}
    assert ids == {n for n, *_ in clean}


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_text_with_some_symbols_goes(spark, share):
    """Junk that holds 5 to 20 symbols in 100 characters, where ordinary text has none."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(500)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    def junk():
        chars = list(prose(150))
        letters = [n for n, c in enumerate(chars) if c != " "]
        for n in r.sample(letters, math.ceil(share * len(letters))):
            chars[n] = r.choice("#*$%&|<>")
        return "".join(chars)

    clean = [(n, prose(r.randrange(40, 400)), "en", "s") for n in range(200)]
    frame = spark.createDataFrame(clean + [(1000 + n, junk(), "en", "s") for n in range(20)], "doc_id long, text string, lang string, source string")
    assert {row["doc_id"] for row in quality_mcd.kept(frame).select("doc_id").collect()} == {n for n, *_ in clean}


def test_small_groups_fall_back_to_their_language_then_to_all(spark):
    """Twenty junk documents of a rare source, or of a rare language, beside large sources: all go, clean ones stay."""
    r = random.Random(9)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(500)]

    def prose(end=""):
        return " ".join(r.choice(vocabulary) + end for _ in range(r.randrange(40, 400)))

    clean = [(n, prose(), "en", f"s{n % 2}") for n in range(200)] + [(n, prose(), "en", "few") for n in range(200, 210)]
    clean += [(n, prose(), "de", "few") for n in range(210, 220)]
    bad = [(1000 + n, prose("%%#"), "en" if n < 20 else "fr", "rare") for n in range(40)]
    frame = spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")
    assert {row["doc_id"] for row in quality_mcd.kept(frame).select("doc_id").collect()} == {n for n, *_ in clean}
    few = spark.createDataFrame(clean[:20] + bad[:20], frame.schema)
    assert quality_mcd.kept(few).count() == 40


def floored(covariance):
    """Every direction has a deviation of at least one floor."""
    floors = np.diag(quality_mcd.FLOORS)
    left, size, right = np.linalg.svd(np.linalg.inv(floors) @ covariance @ np.linalg.inv(floors))
    return floors @ left @ np.diag(np.maximum(size, 1)) @ right @ floors


def plain_determinant_estimate(x, starts):
    """Concentration steps with exact quantiles from every start; the end with the least determinant."""
    factor = quality_mcd.CORE / quality_mcd.chi_square(7, quality_mcd.chi_square_point(5, quality_mcd.CORE))
    ends = []
    for mean, covariance in starts:
        for _ in range(100):
            covariance = floored(covariance)
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(covariance), x - mean)
            core = x[d <= np.quantile(d, quality_mcd.CORE, method="inverted_cdf")]
            mean, covariance = core.mean(axis=0), np.cov(core.T, bias=True) * factor
        covariance = floored(covariance)
        ends.append((np.linalg.slogdet(covariance)[1], mean, covariance))
    return min(ends, key=lambda e: e[0])


def model_of(spark, groups):
    frame = spark.createDataFrame(
        [(lang, source, *map(float, row)) for (lang, source), x in groups.items() for row in x],
        "lang string, source string, " + ", ".join(f"x{i} double" for i in range(5)))
    units, model = quality_mcd.estimates(frame)
    return {(r["lang"], r["source"]): r for r in units.join(model, "unit").collect()}


def by_medians(x):
    mean = np.median(x, axis=0)
    return mean, np.diag((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2)


def test_determinant_estimate_against_numpy(spark, monkeypatch):
    """Several groups, whose names could be taken for each other's; also with the join that many models take."""
    r = np.random.default_rng(1)
    groups = {}
    for n, name in enumerate([("=a", "=b"), ("=a/=b", "-"), ("=a", "-")]):
        x = r.multivariate_normal([5 + n, 1.5, 0.3, 0.3, 0.4], np.diag([1, 0.04, 0.02, 0.02, 0.03]), 2000)
        x[:200] += [0, 2, 2, 2, 2]
        groups[name] = x
    plain = model_of(spark, groups)
    monkeypatch.setattr(quality_mcd, "MOST_BROADCAST", 0)
    salted = model_of(spark, groups)
    for name, x in groups.items():
        _, mean, covariance = plain_determinant_estimate(x, [by_medians(x), (x.mean(axis=0), np.cov(x.T))])
        inverse = np.linalg.inv(covariance)
        for row in (plain[name], salted[name]):
            assert np.allclose([row[f"m{i}"] for i in range(5)], mean, atol=0.02)
            assert np.allclose([row[f"p{i}{j}"] for i, j in quality_mcd.PAIRS], [inverse[i, j] for i, j in quality_mcd.PAIRS], rtol=0.1, atol=0.5)
    assert abs(quality_mcd.chi_square(5, 11.0705) - 0.95) < 1e-4


def test_least_determinant_wins_where_medians_mislead(spark):
    """Points on a tilted line and a fifth of the group beside it: steps from the medians hold on to some of these, subsets do not."""
    r = np.random.default_rng(3)
    along = r.normal(0, 1.0, 2000)
    x = np.stack([5 + 2 * along, 1.5 + along, 0.3 + 0.5 * along, 0.3 - 0.5 * along, 0.4 + along], axis=1) + r.normal(0, 0.15, (2000, 5))
    x[:480] = np.array([5, 1.5, 0.3, 0.3, 0.4]) + np.array([0.9, -0.9, 0.8, 0.8, -0.9]) + r.normal(0, 0.05, (480, 5))
    row = model_of(spark, {("=l", "=s"): x})["=l", "=s"]
    starts = [by_medians(x)] + [(x[few].mean(axis=0), np.cov(x[few].T)) for few in (r.choice(2000, 6, replace=False) for _ in range(60))]
    _, mean, covariance = plain_determinant_estimate(x, starts)
    inverse = np.linalg.inv(covariance)
    assert np.allclose([row[f"m{i}"] for i in range(5)], mean, atol=0.1)
    centre, away = np.array([row[f"m{i}"] for i in range(5)]), np.zeros((5, 5))
    for i, j in quality_mcd.PAIRS:
        away[i, j] = away[j, i] = row[f"p{i}{j}"]
    mine = np.einsum("ni,ij,nj->n", x - centre, away, x - centre)
    theirs = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
    assert np.allclose(mine, theirs, rtol=0.15, atol=0.5)
    assert mine[:480].min() > mine[480:].max()


def test_units_of_equal_points(spark):
    """Repeated rows only, where the medians alone give a model, and points on one line, whose covariance has no inverse."""
    along = np.random.default_rng(5).normal(0, 3, (200, 1)) * np.ones(5)
    rows = model_of(spark, {("=l", "=s"): np.tile([5.0, 1.5, 0.0, 0.0, 0.1], (80, 1)), ("=l", "=line"): along})
    assert np.allclose([rows["=l", "=s"][f"m{i}"] for i in range(5)], [5.0, 1.5, 0.0, 0.0, 0.1])
    assert np.isfinite([rows["=l", "=line"][f"p{i}{j}"] for i, j in quality_mcd.PAIRS]).all()


# ── language ─────────────────────────────────────────────────────────────────────────────────


def test_languages_held_out(docs, rows, spark):
    found = language_em.with_language(docs)
    name = found.columns[-1]
    got = {(r["doc_id"], r["text"]): (r[name], r["out"]) for r in found.withColumn("out", language_em.held_out()).collect()}
    hits = total = 0
    for doc_id, text, lang, *_ in rows:
        verdict, out = got[doc_id, text]
        assert out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2)
        if not re.search(r"[^\W\d_]", text or ""):
            assert verdict["lang_pred"] == "und" and verdict["score"] == 0
        else:
            assert verdict["lang_pred"] in ("en", "de", "fr") and 0 <= verdict["score"] <= 1
        if out and doc_id < 160:
            total, hits = total + 1, hits + (verdict["lang_pred"] == lang)
    assert total > 20 and hits >= 0.9 * total
    mixed = rows[0][1] if rows[0][2] != "de" else rows[1][1]
    half = next(r[1] for r in rows if r[2] == "de")
    frame = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(999, f"{mixed} {half}", None)], "doc_id long, text string, lang string"))
    both = language_em.with_language(frame).filter("doc_id = 999").first()["language"]
    assert len(both["languages"]) == 2 and abs(sum(both["shares"]) - 1) < 1e-3


def test_mixture_against_plain_loops():
    r = np.random.default_rng(0)
    table = np.log(r.dirichlet(np.ones(language_em.CELLS) * 0.05, 3) + 1e-9).astype(np.float32)
    texts = [b"alpha beta gamma delta", b"beta beta", b"epsilon zeta eta theta iota"]
    m = language_em.Mixture(texts, table)
    share, value = m.fit(np.arange(3), np.full((3, 3), 1 / 3), 5)
    for n, text in enumerate(texts):
        words = text.split()
        cells, sizes = language_em.word_grams(words)
        parts = np.split(cells, np.cumsum(sizes)[:-1])
        log = np.array([[row[p].sum() / 3 for row in table.astype(float)] for p in parts])
        pi = np.full(3, 1 / 3)
        for _ in range(5):
            w = pi * np.exp(log - log.max(axis=1, keepdims=True))
            pi = (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
        total = sum(math.log(float((pi * np.exp(row - row.max())).sum())) + row.max() for row in log)
        assert np.allclose(share[n], pi, atol=1e-3) and abs(value[n] - total) < 0.05


def test_language_learns_nothing_from_held_out(docs):
    ids = docs.filter(language_em.held_out()).select("doc_id")
    changed = docs.withColumn("lang", F.when(language_em.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert ids.count() > 10
    assert "xx" not in language_em.learn(changed)[0]


# ── tokens, packing, separator scan ──────────────────────────────────────────────────────────

WORDS, BYTES = tokens.public_path("word_bpe_49k.json"), tokens.public_path("byte_bpe_50k.json")


def library(path, text):
    return tokens.tokenizer(path).encode(text or "", add_special_tokens=False).ids


ALPHABETS = ["abcdefgh tion", "ab", "a", " \n\t a'", "'sreve lld tm's ", "éàß 漢字かな", "0123456789 ", "=-_#! ", "aé漢0 =\n'  ", "²½ªİÀΣ σ"]


def test_ids_equal_the_library():
    r = random.Random(9)
    for n in range(600):
        alphabet = r.choice(ALPHABETS)
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(400)))
        if n % 5 == 0:
            text = text[:50] + "<|endoftext|>" + text[50:]
        found = tree_bpe.encode_texts(BYTES, [text.encode()], r.choice([8, 33, 64, 128]))[0]
        assert found.tolist() == library(BYTES, text)
        assert tree_bpe.decode_ids(BYTES, found) == tokens.tokenizer(BYTES).decode(found.tolist(), skip_special_tokens=False)
        assert tokens.pieces_of(WORDS).encode(pa.array([text]))[0].tolist() == library(WORDS, text)


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    r, pieces = random.Random(1), tokens.Pieces(WORDS)
    for _ in range(30):
        texts = [" ".join(f"{r.choice('abc')}{r.randrange(300)}é" for _ in range(40)), None, ""]
        ids, sizes = pieces.encode(pa.array(texts))
        assert ids.tolist() == library(WORDS, texts[0]) and sizes.tolist()[1:] == [0, 0]


@pytest.mark.parametrize("wide", [1 << 16, 500])
def test_tree_encoding_of_a_table(docs, rows, wide):
    coded = tree_bpe.encode(docs, BYTES, leaf=256, wide=wide)
    assert coded.columns[-1] == "_ids"
    got = collections.Counter((r["doc_id"], r["_ids"].hex() if isinstance(r["_ids"], (bytes, bytearray)) else "") for r in coded.collect())
    wanted = collections.Counter((r[0], np.array(library(BYTES, r[1]), "<u4").tobytes().hex()) for r in rows)
    assert got == wanted
    back = tree_bpe.decode(coded, BYTES, ids="_ids")
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())


def test_packing_of_a_table(docs, rows):
    capacity = 512
    packed = pack_reduction.pack(docs, WORDS, capacity, keep_ids=True)
    got = packed.collect()
    wanted = collections.Counter()
    for row in rows:
        ids = np.array([*library(WORDS, row[1]), 1], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted[(row[0], n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in bins.values():
        parts.sort()
        assert [p[0] for p in parts] == list(itertools.accumulate([0] + [p[1] for p in parts[:-1]]))
        assert parts[-1][0] + parts[-1][1] <= capacity
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in pack_reduction.sequences(packed).collect()}
    assert whole == {k: b"".join(p[2] for p in parts) for k, parts in bins.items()}


def fewest(sizes, capacity):
    """The least number of bins, by search over all assignments."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(n, rooms):
        if len(rooms) >= best[0]:
            return
        if n == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[n]:
                rest = rooms.copy()
                rest.remove(room)
                put(n + 1, [*rest, room - sizes[n]])
        put(n + 1, [*rooms, capacity - sizes[n]])

    put(0, [])
    return best[0]


def test_reduction_keeps_the_optimum_and_best_fit_is_best_fit():
    r = random.Random(11)
    fixed = 0
    for _ in range(250):
        capacity = r.choice([10, 20, 30])
        sizes = [r.randrange(1 if r.random() < 0.3 else capacity // 4, capacity + 1) for _ in range(r.randrange(1, 9))]
        plan, count = pack_reduction.Plan(capacity), dict(collections.Counter(sizes))
        pack_reduction.reduce(count, plan)
        rest = [s for s, n in count.items() for _ in range(n)]
        assert plan.bins + fewest(rest, capacity) == fewest(sizes, capacity)
        fixed += plan.fixed
        # Best-fit decreasing, one item at a time.
        rooms = []
        for s in sorted(rest, reverse=True):
            fits = [x for x in rooms if x >= s]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - s)
        done = pack_reduction.plan_packing(collections.Counter(sizes), capacity)
        assert done.bins == plan.bins + len(rooms)
        filled = collections.defaultdict(list)
        arrays = done.arrays()
        for s, n in collections.Counter(sizes).items():
            for rank in range(n):
                slot = np.searchsorted(arrays["length"] * 2**40 + arrays["first"], s * 2**40 + rank, "right") - 1
                nth = rank - arrays["first"][slot]
                filled[int(arrays["bin"][slot] + nth // arrays["each"][slot])].append(s)
        assert sorted(filled) == list(range(done.bins)) and max(map(sum, filled.values())) <= capacity
    assert fixed > 100
    assert pack_reduction.plan_packing({}).bins == 0


def test_separator_scan(docs, rows, spark, tmp_path):
    end = separator_scan.separator_of(WORDS)
    separator_scan.write_flat(docs, str(tmp_path / "flat"), WORDS, end)
    for block in (7, 64, 1 << 16):
        found = separator_scan.count_documents(spark, str(tmp_path / "flat"), end, block).collect()
        # A separator spelt out in a text is one of its tokens.
        wanted = collections.Counter(len(library(WORDS, r[1])) for r in rows)
        assert collections.Counter(r["n_tokens"] for r in found) == wanted
        for _, group in itertools.groupby(sorted(map(tuple, found)), key=lambda r: r[0]):
            group = list(group)
            assert [g[1] for g in group] == list(range(len(group)))
            assert [g[2] for g in group] == list(itertools.accumulate([0] + [g[3] + 1 for g in group[:-1]]))


def test_separator_scan_of_foreign_files(spark, tmp_path):
    r = random.Random(6)
    streams = [[r.choice([9, 9, 9, 1, 2]) for _ in range(n)] for n in (0, 1, 50, 400)] + [[9, 9, 9], [1, 2, 3]]
    wanted = []
    for n, ids in enumerate(streams):
        (tmp_path / f"part-{n}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        start = 0
        for at, i in enumerate([*ids, 9]):
            if i == 9 and (at < len(ids) or at > start):
                wanted.append((f"part-{n}.bin", start, at - start))
                start = at + 1
    for block in (3, 5, 1000):
        found = separator_scan.count_documents(spark, str(tmp_path), 9, block)
        assert sorted((r["file"], r["start"], r["n_tokens"]) for r in found.collect()) == sorted(wanted)


# ── personal data ────────────────────────────────────────────────────────────────────────────


def plain_base(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        odd = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
        if 14 <= len(digits) <= 19 and odd % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_against_the_patterns():
    r = random.Random(8)
    pieces = ["a@b.c", "x_y@e.f", "@", "a.b", "1.2.3.4", "10.0.0.255.7.8.9.10", "999.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 555-0100",
              "+44", "é", " ", "-", ".", "0", "00012345678903", "++1.2", "\n", "%+", "1" * 30, "a" * 20, "_d@e.f"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 9)))
        assert pii_boost.base_spans(text) == plain_base(text), text


def test_boosted_spans(spark):
    r = random.Random(12)

    def number(n):
        return "".join(str(r.randrange(10)) for _ in range(n))

    def card():
        head = "4" + number(14)
        return next(head + str(d) for d in range(10) if pii_boost.luhn(head + str(d)))

    made = [lambda: f"ann{number(2)}@mail{number(1)}.example.com", lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4)), card,
            lambda: f"+1 ({r.randrange(200, 999)}) 555-{number(4)}", lambda: number(16), lambda: f"{number(3)} {number(2)}", lambda: "plain"]
    texts = [f"some words before {r.choice(made)()} and words after" for _ in range(900)]
    texts += ["write to bob [at] host [dot] com now", "call (415) 555-0199 today", None, "", "the order 1234 of 2024 at home. Then"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row["doc_id"]: row for row in pii_boost.digests(frame).collect()}
    for n, text in enumerate(texts):
        base = plain_base(text or "")
        row = got[n]
        assert [row[f"n_{k}"] for k in pii_boost.KINDS] == [sum(s[2] == k for s in base) for k in range(4)]
        assert row["base_sha256"] == hashlib.sha256(pii_boost.written(base).encode()).hexdigest()
        assert set(pii_boost.written(base).split(",")) <= set(row["spans"].split(",")) or not base
    assert got[900]["spans"] == "email:9:32" and got[901]["spans"] == "phone:5:19"
    assert got[902]["spans"] == got[903]["spans"] == got[904]["spans"] == ""
    clean = pii_boost.redacted(frame.selectExpr("*", "length(text) n_chars"))
    assert clean.filter("doc_id = 901").first()["text"] == "call [PHONE] today"
    none = np.zeros((0, pii_boost.FEATURES + 1), np.int64)
    assert pii_boost.train(none, np.zeros(0), np.zeros(0, bool)).thresholds == (np.inf,) * 4


# ── sharding ─────────────────────────────────────────────────────────────────────────────────


def test_external_shuffle(docs, rows, spark, tmp_path):
    for bucket_bytes in (1 << 20, 2_000):
        found = external_shuffle.shuffled(docs, bucket_bytes=bucket_bytes)
        assert found.columns[: len(docs.columns)] == docs.columns
        shard, grown, slot = found.columns[-3:]
        assert shard == "_shard"
        got = found.collect()
        assert collections.Counter(r["text"] for r in got) == collections.Counter(r[1] for r in rows)
        by = collections.defaultdict(list)
        for r in got:
            assert r[grown] in (r[shard], external_shuffle.SHARDS)
            by[r[shard]].append(r[slot])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert len({(r["doc_id"], r[shard]) for r in got}) == len({r["doc_id"] for r in got})
        again = external_shuffle.shuffled(docs.repartition(5), bucket_bytes=bucket_bytes).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    external_shuffle.write_shards(found, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    ids = spark.range(48_000).withColumn("text", F.lit("t"))
    sizes = [r["n"] for r in external_shuffle.shuffled(ids, id_column="id").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 24 and 1_750 < min(sizes) and max(sizes) < 2_250


# ── URLs ─────────────────────────────────────────────────────────────────────────────────────


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        host, path = m[1].translate(LOWER), m[2]
    fits = [(len(rule), rule, verdict) for verdict, rule in url_rules.RULES
            if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_hand_written_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "http://COM/x", "https://Www.Example.com/en/1?q=//x", "http://x.example.com/en/",
            "http://example.com/en", "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/fr/", "http://a.net/de/", "x://y://z/p#f", "http://é.com/\n/a?b"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for row in url_rules.judged(frame).collect():
        host, path, rule, verdict = plain_rule(urls[row["page_id"]])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert verdict is None or row["verdict"] == verdict
    nothing = url_rules.judged(spark.createDataFrame([(1, "http://a.org/x"), (1, None)], "page_id long, url string"))
    assert [r["verdict"] for r in nothing.collect()] == ["allow", "allow"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_queries_against_sql(name, folder, spark):
    assert differences(queries.queries()[name], queries.oracle_sql()[name], spark, connect(folder), folder) is None


# ── fingerprints ─────────────────────────────────────────────────────────────────────────────


def walk(block):
    """The written sequence of one block, step by step."""
    from crewledger.llm.words import mix, seeds

    symbol = [int(mix(np.array([ord(c) + 1], np.uint64))[0]) for c in block]
    out, at = [], 0
    for factor in (seeds(edit_embedding.STEPS, 14) | np.uint64(1)).tolist():
        out.append(symbol[at] if at < len(symbol) else 0)
        if at < len(symbol):
            at += (symbol[at] * factor % 2**64) >> 63
    return out


def test_embedding_against_single_walks():
    text = "the quick brown fox é漢 jumps over the lazy dog " * 3
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    begin, size = edit_embedding.block_ends(points, np.array([0]), np.array([len(points)]))
    assert sorted(zip(begin.tolist(), size.tolist(), strict=True))[0][0] == 0 and size.sum() == len(text) and size.max() <= edit_embedding.LONGEST
    written = edit_embedding.embedded(points, begin, size)
    for n, (b, s) in enumerate(zip(begin, size, strict=True)):
        assert written[:, n].tolist() == walk(text[b : b + s])
    assert set(edit_embedding.sampled_steps().ravel().tolist()) == set(range(edit_embedding.STEPS))


def test_fingerprints_do_not_depend_on_the_slice():
    texts = [b"", b"abc", "é漢字".encode() * 40, b"x" * 1000, b"word " * 300, b""]
    together = edit_embedding.components(texts)
    assert all((edit_embedding.components([t])[0] == together[n]).all() for n, t in enumerate(texts))


def test_compared_with_next(docs, rows, monkeypatch):
    for per_range in (4_000, 10):
        monkeypatch.setattr(edit_embedding, "PER_RANGE", per_range)
        found = edit_embedding.compared(docs).collect()
        assert len(found) == len(rows)
        tie = lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little", signed=True)
        order = sorted(((r[0] is not None, r[0] or 0, tie(r[1]), r[1] or "") for r in rows))
        wanted = collections.Counter()
        for n, (known, number, _, text) in enumerate(order):
            following = order[(n + 1) % len(order)][3]
            q = len(text) // 4
            wanted[(number if known else None, len(text), hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest())] += 1
        assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == wanted
    long_ones = [r for r in found if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long_ones]) > np.mean([r["near_next"] for r in long_ones]) + 0.3
    assert all(0 <= r[c] <= 1 for r in found for c in ("near_edited", "near_next"))


def test_near_documents_by_bands(docs):
    pairs = {(r["u"], r["v"]) for r in edit_embedding.near_documents(docs).collect()}
    assert (0, 206) in pairs and (0, 207) in pairs and (3, 208) in pairs
    assert all(not (u < 160 and v < 160) for u, v in pairs)


def plain_blocks(text):
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    begin, size = edit_embedding.block_ends(points, np.array([0]), np.array([len(points)]))
    return {text[b : b + n] for b, n in zip(begin, size, strict=True) if n}


def test_linked_documents_against_all_pairs(spark, rows, tmp_path):
    """The query's components are those of all pairs with 70 percent common blocks, also in groups that a star leaves apart."""
    r = random.Random(12)
    texts = [row[:2] for row in rows if row[0] is not None]
    for group in range(6):
        base = [f"w{r.randrange(10**6)}" for _ in range(900)]
        for n in range(12):
            words = list(base)
            for place in r.sample(range(900), r.randrange(0, 40)):
                words[place] = f"x{r.randrange(10**6)}"
            texts.append((1000 + 100 * group + n, " ".join(words)))
    sets = [(n, plain_blocks(t or "")) for n, t in texts]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 70 * len(x | y)]
    label = reach(edges)
    spark.createDataFrame([*texts, (None, "no id")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op10_edit_embedding(spark, str(tmp_path)).collect()
    assert len(found) == len(texts) + 1
    assert {x["doc_id"]: x["component_id"] for x in found} == {n: label.get(n, n) for n, _ in sets} | {None: None}
    assert 1 < len({label.get(n, n) for n, _ in texts if n >= 1000}) < 72


# ── empty tables, pipeline ───────────────────────────────────────────────────────────────────


def test_empty_tables(empty, spark, tmp_path):
    assert quality_mcd.judged(empty).count() == language_em.with_language(empty).count() == pack_reduction.pack(empty, WORDS).count() == 0
    assert pii_boost.digests(empty).count() == external_shuffle.shuffled(empty).count() == tree_bpe.encode(empty, BYTES).count() == 0
    assert minhash_bbit.near_duplicates(empty).count() == edit_embedding.compared(empty).count() == 0
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    separator_scan.write_flat(empty, str(tmp_path / "f"), WORDS, 49407)
    assert separator_scan.count_documents(spark, str(tmp_path / "f"), 49407).count() == 0


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER).checkpoint()
        assert after.columns == columns, name
        assert after.count() > 0.7 * docs.count(), name
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in packed.collect()} == ids
    texts = {r["doc_id"]: len(library(WORDS, r["text"])) + 1 for r in docs.collect()}
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == texts


def test_pipeline_runs_all_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

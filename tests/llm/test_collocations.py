"""Collocations against counting every phrase on its own."""

from __future__ import annotations

import collections
import random
import re

import pytest

from crewledger.llm import collocations, queries
from tests.compare import connect, differences

WINDOW = "lang string, w1 string, w2 string, w3 string, w4 string, c long"
FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, c long, w1 string, phrase string, level string, f string, rank string"


def brute(rows, least, first):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    big = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    held = collections.defaultdict(int)
    for (lang, words), a in big.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                held[lang, words[i : i + m]] = max(held[lang, words[i : i + m]], a)
    best = collections.defaultdict(list)
    for (lang, words), a in big.items():
        if held[lang, words] and 100 * held[lang, words] >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                             for k in range(1, len(words)))
        best[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s)
                  for lang, rows in best.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1))


def corpus():
    r = random.Random(8)
    vocabulary = ["New", "york", "CITY", "the", "a", "of", "é", "漢", "Ä", "x y", "\x1c", "state", "i", "am"]
    weights = [6, 5, 4, 9, 8, 7, 2, 1, 2, 1, 1, 3, 2, 2]
    rows = []
    for _ in range(300):
        words = r.choices(vocabulary, weights, k=r.randrange(0, 60))
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "; "]) for w in words)
        rows.append((text, r.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" ,.\n", "fr"), ("of the state " * 4000, "en"), ("once", "es"), rows[3], rows[3]]


# With a share of 0 every sampled pair counts as hot, with a sample of nothing none does: the result must not change.
@pytest.mark.parametrize("share, sampled, least, first", [(1 / 2000, 0.5, 5, 50), (0.0, 1.0, 5, 2000), (0.2, 0.0, 30, 2000), (0.01, 1.0, 1, 20)])
def test_against_counting_all_phrases(spark, share, sampled, least, first):
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, 1, "w", "p", "l", "f", "r") for i, r in enumerate(rows)], SCHEMA).repartition(5)
    found = collocations.collocations(docs, least=least, first=first, hot_share=share, sampled=sampled)
    assert sorted(map(tuple, found.collect())) == brute(rows, least, first)


def test_no_documents(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scores_past_64_bits(spark):
    """Counts whose products do not fit into 64 bits, from made-up windows."""
    big = 9_000_000_000_000_000
    rows = [("en", "a", "b", None, None, big), ("en", "b", None, None, None, big), ("en", "a", None, None, None, 7)]
    counted = spark.createDataFrame(rows, WINDOW)
    found = {r.phrase: r.f for r in collocations.phrases(counted, 1).collect() if r.k}
    assert found == {"a": big + 7, "b": big, "a b": big}
    (best,) = collocations.best_phrases(collocations.phrases(counted, 1)).collect()
    assert best.score == 2000000 * big // (2 * big + 7) and best.n == 2 * big + 7


def test_plan_rolls_up_windows(spark, capsys):
    counted = spark.createDataFrame([("en", "a", "b", None, None, 3)], WINDOW)
    collocations.phrases(counted, 1).explain()
    assert "Expand" in capsys.readouterr().out


def test_query_against_sql(spark):
    run, sql = queries.queries()["op12_collocations"], queries.oracle_sql()["op12_collocations"]
    assert differences(run, sql, spark, connect(FOLDER), FOLDER) is None

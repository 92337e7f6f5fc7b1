"""The toxicity lexicon: folding, matching against a naive search, held-out accuracy, awkward tables."""

from __future__ import annotations

import random
import zlib

import pytest

from crewledger.llm import queries, toxicity_lexicon as tox

SCHEMA = "doc_id long, text string, lang string, score string, id string, toxic string, words string, h string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("text, wanted", [
    ("You IDIOT!", " you idiot "), ("1d10t 100 b0ss 455", " idiot boss "), ("ѕсum sсυm", " scum scum "), ("ｉｄｉｏｔ ïdíöt", " idiot idiot "),
    ("s​cum l­oser", " scum loser "), ("", " "), ("12 34 !!", " "), ("a$$ m0r@n wh@t! no!", " ass moran what no "), ("漢字 text", " 漢字 text "),
    ("don't\nstop", " don t stop "), ("straße", " strabe "),
])
def test_folding(text, wanted):
    assert tox.folded(text) == wanted


def test_ascii_and_other_texts_fold_alike():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("abzAZ019@$! .-'_\n") for _ in range(30))
        assert tox.folded(text) + "e " == tox.folded(text + " é") or tox.folded(text) == " "


def naive_hits(lexicon, words):
    """Entries and phrases searched one by one at every place."""
    covered = {p for phrase in lexicon.exceptions for s in range(len(words)) if words.startswith(phrase, s) for p in range(s, s + len(phrase) - 1)}
    best = {}
    for s in range(len(words)):
        here = [(w, t) for t, w in lexicon.weights.items() if words.startswith(t, s)]
        if here and s not in covered:
            best[s] = max(here)[0]
    return best


@pytest.mark.parametrize("seed", range(5))
def test_matching_against_search(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 6))) for _ in range(12)]
    terms = {(" " + w if r.random() < 0.5 else f" {w} "): 1 + n / 7 for n, w in enumerate(words)}
    phrases = [f" {r.choice(words)} {r.choice(words)} " for _ in range(3)] + [f" {r.choice(words)} "]
    lexicon = tox.Lexicon(terms, phrases)
    for _ in range(50):
        text = " " + " ".join(r.choice([*words, "zz"]) for _ in range(r.randrange(0, 30))) + " "
        assert {s: terms[t] for s, t in lexicon.hits(text).items()} == naive_hits(lexicon, text)


def corpus(seed=3, count=900):
    """Prose in two languages, toxic texts with marked words, a harmless phrase around one of them, and copies."""
    r = random.Random(seed)
    plain = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 8))) for _ in range(150)]
    bad = ["vilest", "grotten", "mobsch"]
    rows, labels = [], []
    for n in range(count):
        words = [r.choice(plain) for _ in range(r.randrange(5, 160))]
        toxic = n % 6 == 0
        for _ in range(2 + len(words) // 60 if toxic else 0):
            word = r.choice(bad) + r.choice(["", "er", "ing"])
            words.insert(r.randrange(len(words)), r.choice([word, word.upper(), word.replace("o", "0").replace("e", "3"), word.replace("o", "о")]))
        if not toxic and n % 25 == 1:
            words[2:2] = ["kind", "vilest"]
        rows.append((n, " ".join(words), "en"))
        labels.append((n, 1, int(toxic)))
    rows += [(n, rows[6][1], "en") for n in range(count, count + 200)]  # a toxic text with many copies
    labels += [(n, 1, 1) for n in range(count, count + 200)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "s", "i", "t", "w", "h") for r in rows], SCHEMA).repartition(4)
    return docs, spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_exceptions(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    lexicon = tox.learned(docs, marks)
    assert any(term.startswith(" vil") for term in lexicon.weights) and any("kind" in phrase for phrase in lexicon.exceptions)
    scored = tox.scored(docs, lexicon)
    found = {r.doc_id: r[scored.columns[-1]] for r in scored.collect()}
    unseen = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(unseen) > 100 and all((found[i] >= 0.5) == (y == 1) for i, y in unseen)


def test_labels_of_held_out_documents_do_not_matter(spark):
    rows, labels = corpus(count=200)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    one, other = (tox.learned(*frames(spark, rows, y)) for y in (labels, turned))
    assert one.key_figures() == other.key_figures()


def test_awkward_rows(spark):
    rows, labels = corpus(count=240)
    more = [(None, "vilest", None), (5000, None, "en"), (5001, "", None), (5002, "vilest " * 60_000, "en"), (5003, "x" * 500_000, "en"), rows[1], rows[1]]
    labels += [(None, 1, 1), (5000, 0, 0), (5001, 1, None), (9, 1, 0), (777_777, 0, 1)]
    docs, marks = frames(spark, rows + more, labels)
    scored = tox.scored(docs, tox.learned(docs, marks))
    assert scored.columns[:-1] == docs.columns and scored.count() == len(rows) + len(more)
    of = [(r.doc_id, r[scored.columns[-1]]) for r in scored.collect()]
    assert all(0 <= s <= 1 for _, s in of) and len({s for i, s in of if i in (5000, 5001)}) == 1 and len({s for i, s in of if i == rows[1][0]}) == 1
    assert max(of, key=lambda x: x[1])[0] is not None and dict(of)[5002] > 0.5 > dict(of)[5003]


def test_without_labels_and_without_documents(spark):
    rows, labels = corpus(count=60)
    docs, none = frames(spark, rows, [(1, 1, 0)])
    lexicon = tox.learned(docs, none)
    assert not lexicon.weights and {r[-1] for r in tox.scored(docs, lexicon).collect()} == {0.0}
    empty = spark.createDataFrame([], SCHEMA)
    assert tox.scored(empty, tox.learned(empty, none)).collect() == []


def test_query(spark):
    found = queries.queries()["op11_toxicity_lexicon"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 200 and all(r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)

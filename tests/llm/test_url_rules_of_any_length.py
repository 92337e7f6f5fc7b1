"""Mined URL rules of more than two tokens, and path words that are not plain a-z."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from crewledger.llm import url_rules


def test_a_rule_of_three_tokens_decides(spark):
    """Only pages that carry all of three path words are blocked: no rule of fewer tokens is sure enough."""
    rows = []
    for has in itertools.product([0, 1], repeat=3):
        words = [w for w, h in zip(("kauf", "größe-5", "jetzt"), has, strict=True) if h]
        rows += [("block" if all(has) else "allow", words)] * 20
    labelled = spark.createDataFrame([([f"p:{w}" for w in sorted(words)], v) for v, words in rows], "tokens array<string>, verdict string")
    found = {tuple(r["tokens"]): r for r in url_rules.mined(labelled).collect() if r["verdict"] == "block"}
    assert set(found) == {("p:größe-5", "p:jetzt", "p:kauf")} and found["p:größe-5", "p:jetzt", "p:kauf"]["confidence"] == 1.0
    urls = spark.createDataFrame(
        [("all", ["p:größe-5", "p:jetzt", "p:kauf"]), ("two", ["p:jetzt", "p:kauf"])], "url string, tokens array<string>")
    best = {r["url"]: r["best"]["verdict"] for r in url_rules.best_rules(urls, url_rules.mined(labelled), labelled).collect()}
    assert best == {"all": "block", "two": "allow"}


def test_path_words_of_any_script_are_tokens(spark):
    frame = spark.createDataFrame([("http://a.b/Größe-5/книги/384/x.html",), ("http://a.b/",), (None,)], "url string").withColumn("rest", url_rules.rest_of("url"))
    got = [r["t"] for r in frame.select(url_rules.tokens_of("url", F.col("rest")).alias("t")).collect()]
    assert got == [["s:http", "h:a", "h:b", "p:größe-5", "p:книги", "e:html"], ["s:http", "h:a", "h:b"], []]

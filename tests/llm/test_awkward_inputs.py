"""Inputs that once broke an operator: internal names as extra columns, long runs of blanks, separators in texts."""

from __future__ import annotations

import numpy as np
import pytest

from crewledger.llm import external_shuffle, quality_mcd, separator_scan, tokens, tree_bpe

NAMES = ["v", "d", "model", "s", "b", "before", "judged", "judged_counts", "model_lang", "model_source", "shard", "bucket", "place", "slot",
         "x0", "m0", "unit", "c", "n", "h", "k"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, " ".join(f"w{n * k % 37}" for k in range(30 + n)), "en", "a", *["extra"] * len(NAMES)) for n in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES))


def test_quality_rules_with_internal_names(docs):
    found = quality_mcd.judged(docs)
    plain = quality_mcd.judged(docs.select("doc_id", "text", "lang", "source"))
    assert found.columns[:-1] == docs.columns
    name, other = found.columns[-1], plain.columns[-1]
    assert {r.doc_id: tuple(r[name]) for r in found.collect()} == {r.doc_id: tuple(r[other]) for r in plain.collect()}
    assert set(quality_mcd.kept(docs).columns) == set(docs.columns)


def test_external_shuffle_with_internal_names(docs):
    found = external_shuffle.shuffled(docs)
    assert found.columns[:-3] == docs.columns
    plain = external_shuffle.shuffled(docs.select("doc_id", "text"))
    assert {r.doc_id: r[-3:] for r in found.collect()} == {r.doc_id: r[-3:] for r in plain.collect()}


@pytest.mark.parametrize("text", [
    "a" + "\n" * 1_500_000 + "b", " " * 3_000_000, "x" + " \n\t" * 400_000 + " y", "\n" * 5000, "a" + " " * 5000 + "b" + "\t" * 4097, " " * 4096 + "é",
    "1" + " " * 6000 + " z<|endoftext|>" + " " * 9000 + "<|endoftext|>"])
def test_long_runs_of_blanks_encode_as_in_the_library(text):
    path = tokens.public_path("byte_bpe_50k.json")
    wanted = tokens.tokenizer(path).encode(text, add_special_tokens=False).ids
    (found,) = tree_bpe.encode_texts(path, [text.encode()])
    assert np.array_equal(found, np.array(wanted, np.uint32))


def test_separators_in_texts_are_counted(spark, tmp_path):
    path = tokens.public_path("word_bpe_49k.json")
    end = separator_scan.separator_of(path)
    texts = ["a <|endoftext|> b <|endoftext|>", "<|endoftext|>", "", None, "plain words"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    separator_scan.write_flat(docs, str(tmp_path / "flat"), path, end)
    found = separator_scan.count_documents(spark, str(tmp_path / "flat"), end)
    library = tokens.tokenizer(path)
    assert [r.n_tokens for r in found.orderBy("file", "document").collect()] == [
        len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]

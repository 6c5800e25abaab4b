"""Nulls, empty and long texts, repeated rows, empty tables and clashing names in every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from episodia.llm import langid, language_model, licenses, mixing, near_dedup, packing, quality, secrets, suffix_dedup, topk
from episodia.llm.common import ship

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, key string, node long, "
          "_text string, score string, label string, token string, component_id long, `a b` int")
LONG = "the and of with one " * 20_000 + "x" * 50_000


def rows():
    some = "Thing and the other words of a short text that goes on for a while, and then ends here with the rest. " * 3
    texts = [(1, some, "en", "s1"), (1, some, "en", "s1"), (2, some, "fr", None), (3, None, None, None), (4, "", "en", "s1"),
             (None, some, "en", "s1"), (None, None, None, None), (5, LONG, "en", "s2"), (6, "\n \t", "de", ""),
             (7, "token = deadbeefdeadbeefdeadbeef mit license", None, "s1"), (8, "le la les des une " * 30, "fr", "s3")]
    return [(*t, 0, 1, "k", 2, "t", "s", "l", "k", 3, 4) for t in texts]


@pytest.fixture(scope="module")
def messy(spark):
    ship(spark)
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "language": lambda d, _: langid.language_id(d),
    "secrets": lambda d, _: secrets.secret_scan(d),
    "repeats": lambda d, _: suffix_dedup.remove_repeats(d),
    "licenses": lambda d, _: licenses.license_scan(d),
    "near": lambda d, _: near_dedup.near_duplicates(d),
    "quality": lambda d, labels: quality.quality_rules(d, labels),
    "model": lambda d, _: language_model.language_model_scores(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(messy, labels, name):
    ids = sorted((r["doc_id"] or 0 for r in OPERATORS[name](messy, labels).collect()))
    assert ids == sorted(r[0] or 0 for r in rows())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(messy, labels, name):
    assert OPERATORS[name](messy.where("false"), labels.where("false")).collect() == []


def test_packing_mixing_and_vectors(spark, messy):
    assert {r["doc_id"] for r in packing.pack(messy).collect()} == {r[0] for r in rows()}
    assert packing.pack(messy.where("false")).collect() == []
    chosen = mixing.mix(messy, share=2.0, epochs=2)
    assert chosen.columns[:len(messy.columns)] == messy.columns
    taken = chosen.groupBy("_epoch").agg(F.sum("_tokens").alias("n")).collect()
    assert len(taken) == 2 and len({r["n"] for r in taken}) == 1
    assert mixing.mixture(messy.where("false")).collect() == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, score int")
    assert topk.exact_topk(none, F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, messy, tiny, empty):
    docs = messy.where("false") if empty else messy
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, tiny))
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        if name == "language_id" and not empty:
            assert {r["doc_id"] for r in docs.collect()} == {1, 2, None, 5, 7, 8}
        if name == "near_duplicates" and not empty:
            assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 5, 7, 8]
        if name == "secret_scan" and not empty:
            assert docs.where("doc_id = 7").first()["text"] == "[secret] mit license"
    assert (docs.count() == 0) == empty

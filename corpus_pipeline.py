"""Corpus preparation: language, near duplicates, secrets, source weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept. All but the last return the
columns of ``docs``; rows with nulls, repeated rows and further columns pass through them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodia.llm import langid, mixing, near_dedup, packing, secrets
from episodia.llm.common import materialize, read_table, ship

#: no SQL has the models, hashes and tokenizer of these stages; tests hold each against a plain version
ORACLE_SQL = None
MIN_LANGUAGE_SCORE = 0.5
SHINGLE_WORDS, SIMILARITY = 5, 80
TOKEN_SHARE = 0.8  # of the tokens that reach the mixing stage


def apart(*needed: str):
    """Let a stage see its ``needed`` columns alone by name, so that no other column can clash with one of its own."""
    def wrap(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
        @wraps(stage)
        def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            ship(spark)
            names = {c: c if c in needed else f"aside{k}" for k, c in enumerate(docs.columns)}
            found = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
            return found.select(*[F.col(n).alias(c) for c, n in names.items()])
        return run_apart
    return wrap


@apart("text", "lang", "doc_id")
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with the one found as lang; no text, no letter or a low score rejects."""
    model = langid.fit(docs, langid.learnable_rows())
    found = langid.identify(docs, model, "found", "score")
    clear = (F.col("found") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(clear).withColumn("lang", F.col("found"))


@apart("doc_id", "text")
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, once if its row repeats."""
    return near_dedup.one_of_each_group(docs, SHINGLE_WORDS, SIMILARITY)


@apart("text", "n_chars")
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its credentials replaced by a mark and n_chars by the new length."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean


@apart("doc_id", "text", "lang", "source")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the target weights; a document appears once per epoch that takes it."""
    return mixing.mix(docs, TOKEN_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of up to 4096 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixture", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs

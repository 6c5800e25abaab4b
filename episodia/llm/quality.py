"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio. Column expressions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sorted_positions
from ..session import materialize
from .common import SPACE, let

SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
BUCKETS = 1 << 15  # hashed n-gram features; bounds the weights and what the driver holds
SMOOTHING = 1.0
FOLDS = 4  # each trusted document is scored by a model fitted without its fold
LOW_SHARE, MARGIN = 0.002, 0.02  # the cut lies MARGIN below this quantile of the trusted documents' held-out scores
LEAST_HELD = 500  # scores, 1 / LOW_SHARE; the quantile of fewer lies at their least ones, so it only raises the cut
THRESHOLD = -0.2  # mean log ratio per n-gram: the lowest cut by fewer scores, and the cut without any


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeated_words(words: Column, n: Column) -> Column:
    """Number of words in 3-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash. Sorted by (hash, place), equal ones are neighbours; the places of
    those are then walked in order, each adding the words that the one before did not cover.
    """
    def covered(ordered: Column) -> Column:
        twice = F.transform(ordered, lambda x, k: F.when(
            F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)), x["i"]))
        return F.aggregate(
            F.array_sort(F.array_compact(twice)),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
            lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i.cast("long"))).alias("n"),
                                  (i + 3).cast("long").alias("end")))["n"]

    def counted(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, covered))
                .otherwise(F.lit(0).cast("long")))

    return let(F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
                           lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), counted)


def ngram_buckets(words: Column, n: Column, buckets: int) -> Column:
    """Bucket of every word and of every pair of neighbouring words."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    double = F.transform(F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
                         lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, double)


def trusted_folds(labels: DataFrame) -> DataFrame:
    """trusted_id and fold of all labelled documents of quality 1."""
    return (labels.where("quality = 1").select("doc_id").distinct()
            .select(F.col("doc_id").alias("trusted_id"),
                    F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")))


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> list:
    """(bucket, raw, t0, t1, ...): n-grams of all documents, and of the trusted ones of every fold.

    Every task folds its n-grams into at most ``buckets`` rows before the shuffle.
    """
    grams = (docs.join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
             .select("fold", F.explode(let(
                 words_of(F.coalesce("text", F.lit(""))), lambda w: ngram_buckets(w, F.size(w), buckets))).alias("bucket")))
    return grams.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), *[F.count_if(F.col("fold") == k).alias(f"t{k}") for k in range(FOLDS)]).collect()


def log_ratios(counts: list, buckets: int = BUCKETS, left_out: int | None = None,
               smoothing: float = SMOOTHING) -> list[float]:
    """log(target / raw) per bucket, the target without the fold ``left_out``; without a target every ratio is 0."""
    folds = [f"t{k}" for k in range(FOLDS) if k != left_out]
    target_of = {r["bucket"]: sum(r[f] for f in folds) for r in counts}
    raw, target = sum(r["raw"] for r in counts), sum(target_of.values())
    if not target:
        return [0.0] * buckets
    unseen = math.log(smoothing / (target + smoothing * buckets)) - math.log(smoothing / (raw + smoothing * buckets))
    out = [unseen] * buckets
    for r in counts:
        out[r["bucket"]] = (math.log((target_of[r["bucket"]] + smoothing) / (target + smoothing * buckets))
                            - math.log((r["raw"] + smoothing) / (raw + smoothing * buckets)))
    return out


def constant(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one constant


def mean_ratio(weights: Column, words: Column, n: Column, buckets: int) -> Column:
    """Mean log ratio over the n-grams of ``words``; 0 without any."""
    total = let(weights, lambda held: F.aggregate(
        ngram_buckets(words, n, buckets), F.lit(0.0), lambda a, b: a + F.get(held, b)))
    return F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def held_out_cut(docs: DataFrame, trusted: DataFrame, counts: list, buckets: int = BUCKETS) -> float:
    """MARGIN below the LOW_SHARE quantile of trusted documents' scores, each by the model without its fold.

    Only trusted documents that pass the base rules count, and only folds beside which there are others to fit a model
    on. Of less than LEAST_HELD scores the cut is THRESHOLD at least, as models fitted on few documents score others
    low. The scores are written and sorted over tasks, and only those next to the quantile are read, so it is exact
    over any number of them.
    """
    fitted = [k for k in range(FOLDS) if any(r[f"t{other}"] for r in counts for other in range(FOLDS) if other != k)]
    if not fitted:
        return THRESHOLD

    def scored(fold: int) -> DataFrame:
        weights = constant(log_ratios(counts, buckets, fold))
        return (docs.join(F.broadcast(trusted.where(F.col("fold") == fold)), F.col("doc_id") == F.col("trusted_id"))
                .select(F.explode(F.array(let(words_of(F.coalesce("text", F.lit(""))), lambda w: F.struct(
                    base_failed(F.size(w), repeated_words(w, F.size(w))).alias("failed"),
                    mean_ratio(weights, w, F.size(w), buckets).alias("llr"))))).alias("by_word"))
                .where(~F.col("by_word.failed")).select("by_word.llr"))

    scores = materialize(reduce(DataFrame.unionAll, map(scored, fitted)))
    n = scores.count()
    if not n:
        return THRESHOLD
    place = LOW_SHARE * (n - 1)
    below = math.floor(place)
    near = sorted_positions(scores, ["llr"], "place").where(F.col("place").between(below + 1, below + 2)).orderBy("place").collect()
    low, high = near[0]["llr"], near[-1]["llr"]
    cut = low + (place - below) * (high - low) - MARGIN
    return cut if n >= LEAST_HELD else max(cut, THRESHOLD)


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept for every row of ``docs``.

    ``llr`` is the mean log ratio over a text's n-grams (0 without any); ``kept`` is false where base_failed,
    else ``llr >= threshold``, by default the cut of ``held_out_cut``. A null text is empty. Rows are judged
    alone, so repeated rows repeat; null labels are not trusted. One narrow pass, after the counting pass and
    one over the trusted documents per fold.
    """
    docs = docs.select("doc_id", "text")
    trusted = trusted_folds(labels.select("doc_id", "quality"))
    counts = gram_counts(docs, trusted, buckets)
    weights = constant(log_ratios(counts, buckets))
    if threshold is None:
        threshold = held_out_cut(docs, trusted, counts, buckets)
    text = F.coalesce("text", F.lit(""))

    def counted(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast("long").alias("n_words"), repeated_words(words, n).alias("n_repeat_words"),
                        mean_ratio(weights, words, n, buckets).alias("llr"))

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select("doc_id", (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
                    F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
                    let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                    F.explode(F.array(let(words_of(text), counted))).alias("by_word"))
        .select("doc_id", "by_word.*", "word_chars", "n_symbols", "n_dup_lines")
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                "llr"))

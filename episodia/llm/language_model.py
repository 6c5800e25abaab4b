"""Language-model scores: a hashed maximum-entropy model over word classes, trained by averaged local gradients."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remainder, text_bytes, worker_cache

END = b"\n"  # the end of a text; no word holds white space
FREQUENT = 200_000  # most words with an id of their own; bounds what tasks are sent, the rest goes through a join
CLASSES = 24
ROWS = 1 << 15  # hashed features
FEATURES = 4  # previous word, previous two, and the second and third before
BATCH = 4096  # tokens per gradient step
RATE = 0.35
FLUSH = 250_000  # distinct words after which a task hands its counts on


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, and the end."""
    out = text_bytes(text).lower().split()  # both work on ASCII bytes only
    out.append(END)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs``; every task adds up its words before the shuffle."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(tokens(text))
                if len(counts) > FLUSH:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts = Counter()
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return (docs.select("text").mapInPandas(counted, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


class Lexicon:
    """Ids, counts and classes of the frequent words, and the totals of all.

    Classes are runs of equal mass in the order of frequency; the last one holds all words beyond. Within a class
    a word has the share (n + 1) / mass, and one more unseen word belongs to the last class.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, classes: int):
        self.words = END.join(words)  # no word holds the separator; the end itself is told by its place
        self.end_id = words.index(END) if END in words else -1
        self.counts = counts
        self.total, self.distinct = total, distinct
        size, rare = len(words), classes - 1
        self.rare_id = size
        before = np.cumsum(self.counts) - self.counts
        own = before * rare // max(1, int(self.counts.sum()))
        self.class_of = np.append(own, rare).astype(np.int64)
        mass = np.bincount(own.astype(np.int64), weights=self.counts + 1, minlength=classes) if size else np.zeros(classes)
        mass[rare] = total + distinct + 1 - int((self.counts + 1).sum())
        self.log_mass = np.log10(np.maximum(mass, 1))
        self.log_count = np.append(np.log10(self.counts + 1), 0.0)  # of a word beyond: from the join
        self.prior = np.log(np.maximum(mass, 1) / np.maximum(mass, 1).sum())
        self.key = hash((size, total, distinct, self.words[:100_000]))

    def ids(self, words: list[bytes]) -> np.ndarray:
        held = worker_cache(("words", self.key), self.dictionary)
        return np.fromiter(map(held.get, words, repeat(self.rare_id)), np.int64, len(words))

    def histories(self, words: list[bytes]) -> np.ndarray:
        """Ids as features read them: a word beyond the frequent ones has a hash of its bytes above the start mark."""
        ids = self.ids(words)
        rare = np.flatnonzero(ids == self.rare_id)
        hashes = map(zlib.crc32, map(words.__getitem__, rare.tolist()))
        ids[rare] = self.rare_id + 2 + np.fromiter(hashes, np.int64, len(rare))
        return ids

    def dictionary(self) -> dict[bytes, int]:
        own = self.words.split(END) if self.rare_id else []
        if self.end_id >= 0:  # the separator as a word has left two empty strings
            del own[self.end_id]
            own[self.end_id] = END
        return {w: i for i, w in enumerate(own)}


def frequent_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """Words and counts from the most frequent on, at most ``most``.

    The cut comes from a histogram of the logarithms of the counts, so no task sends more than it holds of the
    chosen words.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    total, cut = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(),
                    key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        cut = r["step"]
    if cut is None:
        return [], np.empty(0, dtype=np.int64)
    chosen = counts.where(step >= cut).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return chosen["word"].to_pylist(), chosen["n"].to_numpy()


def feature_rows(ids: list[np.ndarray], start_id: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features [token, feature], token ids) of texts, each one after three start marks."""
    pad = np.full(3, start_id, dtype=np.int64)
    flat = np.concatenate([x for one in ids for x in (pad, one)])
    real = np.flatnonzero(flat != start_id)
    a, b, c = (flat[real - k].astype(np.uint64) for k in (1, 2, 3))
    salt, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - int(math.log2(rows)))
    with np.errstate(over="ignore"):
        mixed = [(a + np.uint64(1)) * salt, ((a << np.uint64(24)) + b + np.uint64(1 << 60)) * salt,
                 (b + np.uint64(2 << 60)) * salt, (c + np.uint64(3 << 60)) * salt]
        mixed = [((m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift for m in mixed]
    return np.stack(mixed, axis=1).astype(np.int64), flat[real]


def log_class(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log of the class probabilities after each history."""
    logits = bias + weights[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        logits += weights[rows[:, k]]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def text_blocks(batches: Iterator[pd.DataFrame], lexicon: Lexicon, size: int = 200_000):
    """Rows of about ``size`` tokens: (frame, words of each text, ``Lexicon.histories`` of each text)."""
    for batch in batches:
        start, held, words = 0, 0, []
        for i, text in enumerate(batch["text"]):
            words.append(tokens(text))
            held += len(words[-1])
            if held >= size or i == len(batch) - 1:
                yield batch.iloc[start:i + 1], words, [lexicon.histories(w) for w in words]
                start, held, words = i + 1, 0, []


def train(docs: DataFrame, lexicon: Lexicon, classes: int = CLASSES, rows: int = ROWS) -> np.ndarray:
    """Weights [hashed feature, class].

    Every task runs one pass of scaled gradient steps over its texts from the class priors and returns the rows it
    touched; a row's weights are then averaged over the tasks, each by how often it used the row.
    """
    names = [f"w{k}" for k in range(classes)]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.zeros((rows, classes), dtype=np.float32)
        scale = np.full((rows, 1), 1e-6, dtype=np.float32)
        used = np.zeros(rows, dtype=np.int64)
        bias = lexicon.prior.astype(np.float32)
        for _, _, ids in text_blocks(batches, lexicon):
            features, flat = feature_rows(ids, lexicon.rare_id + 1, rows)
            flat = np.minimum(flat, lexicon.rare_id)  # as a target a rare word is one of the last class
            target = lexicon.class_of[flat]
            used += np.bincount(features.ravel(), minlength=rows)
            for at in range(0, len(flat), BATCH):
                part, wanted = features[at:at + BATCH], target[at:at + BATCH]
                error = np.exp(log_class(weights, bias, part))
                error[np.arange(len(wanted)), wanted] -= 1
                hashed = part.ravel()
                order = np.argsort(hashed.astype(np.uint16) if rows <= 1 << 16 else hashed, kind="stable")  # radix sort
                firsts = np.flatnonzero(np.diff(hashed[order], prepend=-1))
                touched = hashed[order[firsts]]
                gradient = np.add.reduceat(error[order // FEATURES], firsts, axis=0)
                scale[touched, 0] += (gradient ** 2).sum(axis=1)
                weights[touched] -= RATE * gradient / np.sqrt(scale[touched])
        touched = np.flatnonzero(used)
        out = pd.DataFrame(weights[touched], columns=names)
        yield out.assign(row=touched, used=used[touched])

    schema = ", ".join(f"{n} float" for n in names) + ", row int, used long"
    sums = (docs.select("text").mapInPandas(local, schema).groupBy("row")
            .agg(*[(F.sum(F.col(n) * F.col("used")) / F.sum("used")).cast("float").alias(n) for n in names]).toPandas())
    weights = np.zeros((rows, classes), dtype=np.float32)
    weights[sums["row"]] = sums[names].to_numpy()
    return weights


def score_texts(docs: DataFrame, training: Column, frequent: int = FREQUENT, classes: int = CLASSES,
                rows: int = ROWS) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows where ``training`` holds. ``score`` is the log10 probability of the text: of each token's
    class after its history by the maximum-entropy model, and of the token within its class by its count. Counts
    are exact for all words: frequent ones by their ids, the others by a join. A null or empty text is the end
    alone; without training rows every token has the same share of nothing seen. Rows are scored each, also
    repeated ones.
    """
    learned = docs.where(training)
    counts = materialize(word_counts(learned))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("word").alias("v")).first()
    lexicon = Lexicon(*frequent_words(counts, frequent), whole["n"], whole["v"], classes)
    weights = train(learned, lexicon, classes, rows)
    bias = lexicon.prior.astype(np.float32)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, words, ids in text_blocks(batches, lexicon):
            features, flat = feature_rows(ids, lexicon.rare_id + 1, rows)
            flat = np.minimum(flat, lexicon.rare_id)  # as a target a rare word is one of the last class
            lengths = np.array([len(x) for x in ids])
            of_class = lexicon.class_of[flat]
            by_class = np.empty(len(flat))
            for at in range(0, len(flat), 8192):
                part = log_class(weights, bias, features[at:at + 8192])
                by_class[at:at + 8192] = part[np.arange(len(part)), of_class[at:at + 8192]]
            firsts = np.cumsum(lengths) - lengths
            log_n = lexicon.log_count[flat]
            model = by_class / math.log(10) + log_n - lexicon.log_mass[of_class]
            beyond = flat == lexicon.rare_id
            others = [Counter(w[i] for i in np.flatnonzero(beyond[f:f + n]))
                      for w, f, n in zip(words, firsts, lengths)]
            yield pd.DataFrame({
                "row": frame["row"].to_numpy(), "doc_id": frame["doc_id"].array, "held_out": frame["held_out"].array,
                "n_tokens": lengths, "frequent": np.add.reduceat(~beyond, firsts, dtype=np.int64),
                "log_n": np.add.reduceat(log_n, firsts), "model": np.add.reduceat(model, firsts),
                "words": [list(c) for c in others], "times": [list(c.values()) for c in others]})

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    parts = materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInPandas(
            scored, f"row long, doc_id {doc_id}, held_out boolean, n_tokens long, frequent long, log_n double, "
                    "model double, words array<binary>, times array<long>"))
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        F.col("row").alias("rare_row"), F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    known = (rare.join(counts, "word").groupBy("rare_row").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more")))
    spread = math.log10(lexicon.total + lexicon.distinct + 1)
    more = F.coalesce("more", F.lit(0.0))
    return (parts.drop("words", "times").join(known, F.col("row") == F.col("rare_row"), "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("frequent") + F.coalesce("known", F.lit(0))).alias("n_known"),
                    F.lit(lexicon.total).cast("long").alias("train_tokens"),
                    (F.col("log_n") + more - F.col("n_tokens") * spread).alias("base_score"),
                    (F.col("model") + more).alias("score")))


def language_model_scores(docs: DataFrame, modulus: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out and the scores of ``score_texts``; trained outside the held-out fold."""
    table = docs.select("doc_id", "text").withColumn("held_out", remainder(modulus) == fold)
    return score_texts(table, ~F.col("held_out"))

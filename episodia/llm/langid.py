"""Language identification by unigram piece models, summed over all segmentations of a word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, remainder, worker_cache

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"  # what the vocabulary puts before a word
LONGEST_PIECE = 16
LONGEST_WORD = 64  # longer runs of letters are scored in parts of this length
TRAIN_DOCS = 500  # documents per language that the models are fitted on
ROUNDS = 3  # of expectation maximisation
FIT_TASKS = 16  # over which a round of it is spread
SMOOTHING = 0.01
UNKNOWN = 1e-4  # probability of a character that no piece of the vocabulary spells
KEEP = 250_000  # words whose scores a worker remembers
UNDETERMINED = "und"


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a public SentencePiece vocabulary that have no capitals, control or byte pieces."""
    from sentencepiece import SentencePieceProcessor

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return [p for p in pieces if p == p.lower() and len(p) <= LONGEST_PIECE]


class Pieces:
    """Piece numbers of substrings, by a hash table that is probed for whole arrays at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        hashes = np.array([self.hash_of(p) for p in pieces], dtype=np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(pieces) + 1))))
        size = 1 << self.bits
        self.keys, self.numbers, self.probes = np.zeros(size, np.uint64), np.full(size, -1, np.int64), 1
        for number, h in enumerate(hashes):
            slot, probe = int(h >> np.uint64(64 - self.bits)), 1
            while self.numbers[slot] >= 0:
                slot, probe = (slot + 1) % size, probe + 1
            self.keys[slot], self.numbers[slot], self.probes = h, number, max(self.probes, probe)

    @classmethod
    def hash_of(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(cls.BASE)) % 2**64
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 where there is none."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.numbers[slot], -1)
        for probe in range(1, self.probes):
            at = (slot + probe) & ((1 << self.bits) - 1)
            out = np.where((out < 0) & (self.keys[at] == hashes), self.numbers[at], out)
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Numbers [l, word, start] of the pieces of length l + 1 in words of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
        length = codes.shape[1]
        longest = min(length, LONGEST_PIECE)
        out = np.full((longest, len(words), length), -1, dtype=np.int64)
        plus = codes.astype(np.uint64) + np.uint64(1)
        h = np.zeros_like(plus)
        with np.errstate(over="ignore"):
            for k in range(longest):
                h = (h[:, :length - k] + plus[:, k:]) * self.BASE
                out[k, :, :length - k] = self.find(h)
        out[0][out[0] < 0] = len(self.pieces)  # a character that no piece spells
        return out, length


def by_length(words: list[str], block: int = 4096) -> Iterator[np.ndarray]:
    """Places of words of the same length, a block at a time."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts):
        for start in range(0, len(part), block):
            yield part[start:start + block]


def forward(lattice: np.ndarray, length: int, table: np.ndarray) -> np.ndarray:
    """Probability [end, word, language] of every prefix, summed over its segmentations.

    ``table`` has a row per piece, one for unknown characters and, last, a row of zeros for no piece.
    """
    total = np.zeros((length + 1, lattice.shape[1], table.shape[1]))
    total[0] = 1
    for end in range(1, length + 1):
        for k in range(min(end, len(lattice))):
            total[end] += total[end - k - 1] * table[lattice[k, :, end - k - 1]]
    return total


def backward(lattice: np.ndarray, length: int, table: np.ndarray) -> np.ndarray:
    total = np.zeros((length + 1, lattice.shape[1], table.shape[1]))
    total[length] = 1
    for start in range(length - 1, -1, -1):
        for k in range(min(length - start, len(lattice))):
            total[start] += total[start + k + 1] * table[lattice[k, :, start]]
    return total


def word_parts(text: str) -> list[str]:
    """Lower-case words of letters, marked at their start, in parts of bounded length."""
    words = LETTERS.findall(text.lower())
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    return [w[i:i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]


class Model:
    """Piece probabilities per language."""

    def __init__(self, pieces: list[str], languages: list[str], table: np.ndarray):
        self.pieces, self.languages, self.table = pieces, languages, table

    def scorer(self) -> WordScorer:
        return WordScorer(self)


class WordScorer:
    """Log probability per language of words, remembered between batches."""

    def __init__(self, model: Model):
        self.finder, self.model = Pieces(model.pieces), model
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)))

    def learn(self, new: list[str]) -> None:
        out = np.empty((len(new), len(self.model.languages)))
        for at in by_length(new):
            lattice, length = self.finder.lattice([START + new[i] for i in at])
            out[at] = np.log(np.maximum(forward(lattice, length, self.model.table)[length], 1e-300))
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.scores = np.concatenate([self.scores, out])

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for start in range(0, len(texts), 512):
            split = [word_parts(t or "") for t in texts[start:start + 512]]
            every = set().union(*split)
            new = every - self.rows.keys()
            if len(self.rows) + len(new) > KEEP:
                self.rows, new = {}, every
                self.scores = self.scores[:0]
            self.learn(list(new))
            for words in split:
                if not words or not self.model.languages:
                    yield UNDETERMINED, 0.0
                    continue
                at = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
                total = self.scores[at].sum(axis=0)
                best = int(total.argmax())
                yield self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, learnable: Column, vocabulary_path: str | None = None, train_docs: int = TRAIN_DOCS,
        rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language by expectation maximisation.

    Fitted on at most ``train_docs`` documents per language, those with the smallest hashes of their ids among
    the ``learnable`` ones with a lang and text. Their word counts are a table; each round is one pass over it
    that sums expected piece counts, at most one row per piece and language.
    """
    from functools import reduce

    pieces = vocabulary(vocabulary_path)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = (docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= train_docs)
              .select("doc_id").distinct())
    sample = docs.join(F.broadcast(ranked), "doc_id").where(learnable & F.col("lang").isNotNull()).select("lang", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"]):
                counts.update((lang, w) for w in word_parts(text or ""))
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "word", "n"])

    words = materialize(sample.mapInPandas(counted, "lang string, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(FIT_TASKS, "word"))
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    column = {lang: i for i, lang in enumerate(languages)}
    # one row for unknown characters and one of zeros follow the pieces
    table = np.full((len(pieces) + 2, max(1, len(languages))), 1 / len(pieces))
    table[-2], table[-1] = UNKNOWN, 0

    def expected(table: np.ndarray):
        def pass_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = Pieces(pieces)
            counts = np.zeros_like(table)
            for batch in batches:
                for lang, part in batch.groupby("lang"):
                    own = table[:, [column[lang]]]
                    held, n = part["word"].tolist(), part["n"].to_numpy(dtype=float)
                    for at in by_length(held):
                        lattice, length = finder.lattice([START + held[i] for i in at])
                        ahead, behind = forward(lattice, length, own)[..., 0], backward(lattice, length, own)[..., 0]
                        share = n[at] / np.maximum(ahead[length], 1e-300)
                        for k in range(len(lattice)):
                            for start in range(length - k):
                                number = lattice[k, :, start]
                                used = share * ahead[start] * own[number, 0] * behind[start + k + 1]
                                np.add.at(counts[:, column[lang]], number, used)
            piece, lang = np.nonzero(counts[:-2])
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": counts[piece, lang]})

        return pass_over

    for _ in range(rounds if languages else 0):
        sums = (words.mapInPandas(expected(table), "piece int, lang int, n double")
                .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas())
        counts = np.zeros((len(pieces), len(languages)))
        counts[sums["piece"], sums["lang"]] = sums["n"]
        table[:-2] = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(pieces))
    return Model(pieces, languages, table)


def identify(docs: DataFrame, model: Model, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns, from each whole text alone.

    ``score`` is the share of the language among all languages' probabilities of the text. A text that is null
    or has no letter is ``und`` with score 0, as is every text if no language was learned.
    """
    key = model.table[:: max(1, len(model.table) // 997)].tobytes()

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = worker_cache(("languages", key), model.scorer)
        for batch in batches:
            yield pd.DataFrame(list(scorer.predict(batch.tolist())), columns=["lang", "share"])

    # not deterministic for the optimizer only, so that a filter does not run it again
    found = F.pandas_udf(predicted, "lang string, share double").asNondeterministic()
    own = [F.col(f"`{c}`") for c in docs.columns]
    return (docs.select(*own, found("text").alias("_identified"))
            .select(*own, F.col("_identified.lang").alias(lang_pred), F.col("_identified.share").alias(score)))


def learnable_rows(modulus: int = 4, fold: int = 2) -> Column:
    """Rows outside the held-out fold."""
    return remainder(modulus) != fold


def language_id(docs: DataFrame, modulus: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents outside the held-out fold only."""
    table = docs.select("doc_id", "text", "lang")
    model = fit(table, learnable_rows(modulus, fold))
    return identify(table, model).select("doc_id", (~learnable_rows(modulus, fold)).alias("held_out"),
                                         "lang_pred", "score")

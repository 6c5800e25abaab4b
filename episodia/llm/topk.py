"""Exact top-k inner products by term-at-a-time accumulation over blocks of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORED = "query_id long, vec_id long, score long"
QUERY_TILE = 64  # query rows whose dense score arrays are held at once
DENSE = 0.25  # a posting list longer than this share of its block is kept as a dense array


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, weights): ``floor(scale * x)`` of every component.

    Vectors that are null or hold a null, NaN or infinite component take no part, nor do null ids. Rows that
    share an id count once, with the smallest of their vectors.
    """
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & clean)
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("weights")))


def flat(weights: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every nonzero entry."""
    lengths = np.array([len(w) for w in weights], dtype=np.int64)
    values = np.concatenate([np.asarray(w, dtype=np.int64) for w in weights]) if len(weights) else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = values != 0
    return rows[some], terms[some], values[some]


def postings(weights: pd.Series, dtype) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """Per term the candidates that hold it and their weights; (None, dense array) for a long list."""
    rows, terms, values = flat(weights)
    order = np.argsort(terms, kind="stable")
    rows, terms, values = rows[order], terms[order], values[order].astype(dtype)
    out = {}
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else []
    for start, end in zip(starts, [*starts[1:], len(terms)]):
        at, held = rows[start:end], values[start:end]
        if end - start > DENSE * len(weights):
            dense = np.zeros(len(weights), dtype=dtype)
            dense[at] = held
            at, held = None, dense
        out[int(terms[start])] = (at, held)
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best candidates other than ``own``; ids ascend, so ties go to the smaller place."""
    cut = min(k + 1, len(scores))  # one more, as the query itself may be among them
    least = np.partition(scores, len(scores) - cut)[len(scores) - cut]
    above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)[:cut]
    at = np.concatenate([above, level])
    at = at[ids[at] != own]
    return at[np.lexsort((ids[at], -scores[at].astype(np.int64)))][:k]


def block_scores(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best of one block of candidates for each query of one block of queries."""
    if not len(queries) or not len(candidates):
        return
    candidates = candidates.sort_values("vec_id", ignore_index=True)
    ids = candidates["vec_id"].to_numpy()

    def size(weights):
        return max((float(np.abs(np.asarray(w, dtype=np.float64)).sum()) for w in weights), default=0.0)

    def peak(weights):
        return max((float(np.abs(np.asarray(w, dtype=np.float64)).max(initial=0)) for w in weights), default=0.0)

    dtype = np.int32 if size(queries["weights"]) * peak(candidates["weights"]) < 2**31 - 1 else np.int64
    lists = postings(candidates["weights"], dtype)
    for start in range(0, len(queries), QUERY_TILE):
        tile = queries.iloc[start:start + QUERY_TILE]
        rows, terms, values = flat(tile["weights"])
        scores = np.zeros((len(tile), len(ids)), dtype=dtype)
        product = np.empty_like(scores)
        for term in np.unique(terms):
            if int(term) not in lists:
                continue
            at, held = lists[int(term)]
            mine = terms == term
            q, w = rows[mine], values[mine].astype(dtype)[:, None]
            if at is not None:
                scores[q[:, None], at] += w * held
            elif len(q) == len(tile):
                np.multiply(w, held, out=product)
                scores += product
            else:
                scores[q] += w * held
        own = tile["vec_id"].to_numpy()
        for i in range(len(tile)):
            at = best(scores[i], ids, own[i], k)
            yield pd.DataFrame({"query_id": own[i], "vec_id": ids[at], "score": scores[i][at].astype(np.int64)})


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0,
               query_block: int = 1024, candidate_block: int = 8192) -> DataFrame:
    """Per query the ``k`` largest integer inner products over all other rows.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows than ``k`` give
    all of them. Both sides are cut into blocks by a hash of the id, and every pair of a query block and a
    candidate block is one task that holds ``query_block + candidate_block`` rows at most on average, however
    large the table. A shorter vector counts as filled up with zeros; an empty table gives an empty result.
    Products are 64-bit integers.
    """
    table = quantised(vectors.select("vec_id", "embedding"), scale)
    asked = vectors.where(is_query & F.col("vec_id").isNotNull()).select("vec_id")
    rows, wanted = vectors.agg(F.count("vec_id")).first()[0], asked.count()
    across, down = max(1, -(-rows // candidate_block)), max(1, -(-wanted // query_block))

    def blocks(df: DataFrame, own: str, other: str, n_own: int, n_other: int, salt: int) -> DataFrame:
        every = F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))
        return df.select("vec_id", "weights", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n_own)).alias(own),
                         F.explode(every).alias(other))

    candidates = blocks(table, "across", "down", across, down, 1)
    queries = blocks(table.where(is_query), "down", "across", down, across, 2)

    def scored(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = list(block_scores(q, c, k))
        if not parts:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.concat(parts)

    per_block = queries.groupBy("across", "down").cogroup(candidates.groupBy("across", "down")).applyInPandas(
        scored, SCORED)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (per_block.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

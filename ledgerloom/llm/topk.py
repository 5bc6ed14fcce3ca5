"""Exact top-k search by inner product: three phases with a uniform threshold.

A score is a sum of partial scores, one for each of a few slices of the dimensions; each slice is a list of partial scores. The phases:

1. Each task gathers the first k entries of every list, resolves their whole scores (the other slices lie in the same row) and sends each
   query's k best. The k-th best of all tasks is a safe cutoff: k candidates reach it.
2. The cutoffs are broadcast. A candidate that reaches the cutoff has a partial score of at least cutoff / lists in some list, so
   each list collects the entries from there on.
3. For those entries alone the remaining partial scores are added; those that reach the cutoff are ranked exactly.

Queries are handled in chunks of bounded size, all candidates as blocks of matrices (see vectors), so that the result of any task is at most
k rows for each query of a chunk.

Defined cases: see vectors; a query's own row, and any other with its id, is no candidate; repeated rows are candidates each, and a
repeated query is answered each time; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import written

_FOUND = "number long, vec_id long, score long"


def _slices(d: int, lists: int) -> list[slice]:
    cuts = [d * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _partials(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    d = min(q.shape[1], c.shape[1])
    return [V.products(q[:, s], c[:, s]) for s in _slices(d, lists)]


def _queries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["vec_id"].to_numpy(), V.decoded(table["vec"], 1)[1]


def _gather(sent, scale: int, k: int, lists: int, first: int):
    """Phase 1: the k best whole scores among the first k entries of every list, per task."""

    def run(batches):
        own, q = sent.value
        best = V.Best(len(own), k)
        for ids, _, c in V.blocks(batches, scale):
            for rows in V.heights(q):
                partial, other = _partials(q[rows], c, lists), own[rows][:, None] != ids[None, :]
                seen = np.zeros(other.shape, bool)
                for p in partial:
                    np.put_along_axis(seen, V.first(p, other, k), True, 1)
                best.add(rows, sum(partial), seen & other, ids)
        yield best.table(first)

    return run


def _collect(sent, scale: int, k: int, lists: int, first: int):
    """Phases 2 and 3: entries of any list from cutoff / lists on, then their whole scores from the cutoff on."""

    def run(batches):
        own, q, cutoff = sent.value
        best = V.Best(len(own), k)
        for ids, _, c in V.blocks(batches, scale):
            for rows in V.heights(q):
                partial, least = _partials(q[rows], c, lists), cutoff[rows][:, None]
                enough = own[rows][:, None] != ids[None, :]
                enough &= np.logical_or.reduce([(lists * p >= least).astype(bool) for p in partial])
                whole = np.full(enough.shape, -np.inf, partial[0].dtype)
                at = np.nonzero(enough)
                whole[at] = sum(p[at] for p in partial)
                best.add(rows, whole, enough & (whole >= least).astype(bool), ids)
        yield best.table(first)

    return run


def search(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, lists: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = V.CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each row where is_query holds with every other row.
    Components become floor(scale * component)."""
    spark = rows.sparkSession
    queries, n, d = V.numbered(V.quantised(rows.where(is_query), scale, id_col, vector_col), "search-queries")
    given = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).alias("label"), F.col(vector_col).alias("vec"))
    parts = []
    for first, table in V.chunked(queries, n, d, chunk):
        own, q = _queries(table)
        gathered = given.mapInArrow(_gather(spark.sparkContext.broadcast((own, q)), scale, k, lists, first), _FOUND)
        last = V.ranked(gathered, ["number"], k).where(F.col("rank") == k).select("number", "score").toArrow()  # a row for each query of the chunk
        cutoff = np.full(len(own), -np.inf)
        cutoff[last["number"].to_numpy() - first] = _below(last["score"].to_numpy())
        collected = given.mapInArrow(_collect(spark.sparkContext.broadcast((own, q, cutoff)), scale, k, lists, first), _FOUND)
        parts.append(written(V.ranked(collected, ["number"], k), "search-found"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = queries.select("number", F.col("vec_id").alias("query_id"))
    return V.together(parts).join(names, "number").select("query_id", "rank", "vec_id", "score")


def _below(scores: np.ndarray) -> np.ndarray:
    """Cutoffs as doubles that are not above the scores; a score at either end of 64 bits may stand for one beyond."""
    out = scores.astype(np.float64)
    out = np.where(np.abs(out) < 2.0**53, out, np.nextafter(out, -np.inf))
    return np.where(scores == np.iinfo(np.int64).min, -np.inf, out)

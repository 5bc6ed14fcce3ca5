"""Integer vectors in blocks: what the searches over embeddings share.

Vectors become float64 matrices whose inner products are integers below 2^53, so that one matrix product gives exact scores. Queries are
numbered and handled in chunks of bounded size: a chunk is collected, broadcast and set against all rows, block by block; the best rows
of each query are kept per task and merged by a window.

Defined cases: a row with a null id or vector, or with any component that is null, not finite or too large for a double when scaled, takes
no part. Shorter vectors count as padded with zeros. Rows beyond the exact range of a double (see LIMIT) are scored with Python's
integers and by themselves; a score beyond 64 bits is returned as the nearest 64-bit integer.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block of candidates, and of queries that meet it at a time.
WIDTH, HEIGHT = 4096, 512
#: Scores stay below this, so that score * WIDTH + column is exact in a double.
LIMIT = 2.0**40
#: Bytes of query vectors that are collected and broadcast at a time.
CHUNK = 32 << 20
NONE = np.iinfo(np.int64).max


def decoded(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can take part, and those rows as a matrix of floor(scale * component)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) * scale)
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return good, values.reshape(-1, width)[good]
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - (ends - lengths)[rows]] = values
    return good, out[good]


def _plain(m: np.ndarray) -> np.ndarray:
    """Rows that stay below LIMIT with any other such row."""
    return np.abs(m).max(axis=1, initial=0) <= np.sqrt(LIMIT / max(1, m.shape[1]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, as doubles where those are exact, else as Python's integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if _plain(a).all() and _plain(b).all():
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return np.dot(whole(a), whole(b).T) if d else np.zeros((len(a), len(b)))


def quantised(df: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", label=None) -> DataFrame:
    """vec_id, label (null where none is asked for) and vec (array of doubles with whole values) of the rows that take part."""
    label = F.lit(None) if label is None else label

    def run(batches):
        for b in batches:
            good, m = decoded(b.column(2), scale)
            vec = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), max(1, m.shape[1])) if m.shape[1] else pa.array([[]] * len(m), pa.list_(pa.float64()))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), vec.cast(pa.list_(pa.float64()))], ["vec_id", "label", "vec"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), vector_col)
    return rows.mapInArrow(run, "vec_id long, label long, vec array<double>")


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """df as a stored table with `number` from 0 without gaps, the number of its rows, and the longest of its vectors (vec)."""
    rows = written(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"))
    held = sizes.collect()  # a row for each task that wrote
    starts, n = [], 0
    for r in sorted(held, key=lambda r: r["_part"]):
        starts.append((r["_part"], n))
        n += r["n"]
    if not n:
        return rows.drop("_at").withColumn("number", F.lit(0).cast("long")), 0, 0
    spark = df.sparkSession
    before = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))  # as many rows
    out = rows.withColumn("_part", part.cast("long")).join(before, "_part").withColumn("number", F.col("_before") + place)
    return out.drop("_at", "_part", "_before"), n, max(r["d"] for r in held)


def chunked(queries: DataFrame, n: int, d: int, most: int = CHUNK):
    """The numbered queries in chunks of at most `most` bytes: (first number, table in order of numbers)."""
    each = max(1, most // (8 * max(1, d)))
    for first in range(0, n, each):
        yield first, queries.where(F.col("number").between(first, min(n, first + each) - 1)).toArrow().sort_by("number")


def blocks(batches, scale: float, width: int = WIDTH):
    """(ids, labels, matrix) of the rows that take part, ids ascending in each block. Rows that need Python's integers come apart. Columns
    of the batches: id, label, vector."""
    for batch in batches:
        good, m = decoded(batch.column(2), scale)
        keep = pa.array(good)
        ids, labels = (batch.column(i).filter(keep).to_numpy(zero_copy_only=False) for i in (0, 1))
        plain = _plain(m)
        for part in (plain, ~plain):
            at = np.flatnonzero(part)
            at = at[np.argsort(ids[at], kind="stable")]
            for i in range(0, len(at), width):
                k = at[i : i + width]
                yield ids[k], labels[k], m[k]


def heights(m: np.ndarray, height: int = HEIGHT):
    """Row numbers of a query matrix, some at a time; those that need Python's integers apart."""
    plain = _plain(m)
    for part in (plain, ~plain):
        at = np.flatnonzero(part)
        for i in range(0, len(at), height):
            yield at[i : i + height]


class Best:
    """The first k candidates of each query by score (higher first), then id (smaller first)."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), NONE)

    def add(self, rows: np.ndarray, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """Of a block: scores[i, j] of query rows[i] with candidate ids[j] (ascending), where valid."""
        valid = valid & (scores >= self.scores[rows, -1][:, None]).astype(bool)
        hit = np.flatnonzero(valid.any(axis=1))
        if not hit.size:
            return
        scores, valid, rows = scores[hit], valid[hit], rows[hit]
        if scores.dtype == object and self.scores.dtype != object:
            self.scores = self.scores.astype(object)
        width, k = scores.shape[1], self.ids.shape[1]
        at = first(scores, valid, k)
        s = np.take_along_axis(np.where(valid, scores, -np.inf), at, 1)
        found = np.where(np.take_along_axis(valid, at, 1), ids[at], NONE)
        s, found = np.concatenate((self.scores[rows], s), 1), np.concatenate((self.ids[rows], found), 1)
        order = np.argsort(found, axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(s, order, 1), axis=1, kind="stable"), 1)[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(found, order, 1)

    def table(self, first: int, **more: np.ndarray) -> pa.RecordBatch:
        """number (the query's, from `first`), vec_id and score of all kept; more: further columns, by query."""
        q, at = np.nonzero(self.ids != NONE)
        score = self.scores[q, at]
        if score.dtype == object:
            score = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in score], np.int64)
        further = {name: pa.array(x[q]) for name, x in more.items()}
        return pa.RecordBatch.from_pydict({"number": pa.array(q + first) if not more else further.pop("number"), **further, "vec_id": pa.array(self.ids[q, at]), "score": pa.array(score.astype(np.int64))})


def first(scores: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best valid scores of each row, ties to the smaller column, in no order."""
    width = scores.shape[1]
    if width <= k:
        return np.broadcast_to(np.arange(width), scores.shape)
    keys = np.where(valid, scores * width - np.arange(width), -np.inf)
    return np.argpartition(keys, width - k, axis=1)[:, width - k :]


def ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group by score and vec_id, with `rank`; Spark cuts each task's groups to k before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def together(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, parts)

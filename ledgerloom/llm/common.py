"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.closure import components
from ledgerloom.sources.shared import shared_folder

__all__ = ["best_segments", "components", "crc_mod", "dropped", "lower_ascii", "scratch", "shared_folder", "slices", "split_words", "table", "text_bytes", "written"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


#: Spark's setting by which a query's shuffle files go when it has ended, not once the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written within each `scratch` that is open.
_open: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is computed once. The shuffle files that it took are deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for made in _open[-1:]:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that `written` makes within at the end, but for those that are given to what this returns."""
    _open.append([])
    kept: list[DataFrame] = []
    try:
        yield lambda df: kept.append(df) or df
    finally:
        made = _open.pop()
        dropped(*(df for df in made if not any(df is k for k in kept)))
        for outer in _open[-1:]:
            outer.extend(kept)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str, m: int = 5) -> Column:
    """crc32 of a column as text, modulo m; -1 where it is null."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(m)), F.lit(-1)).cast("int")


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """The batch in slices of about `most` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0)).tolist()
    for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if e > s:
            yield batch.slice(s, e - s)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The ASCII-lower-cased words of all texts, dictionary-coded, and the bounds of each text's words. White space at either
    end of a text leaves an empty word."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    return split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of a text column (one aggregate)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]


def best_segments(steps) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last step), of steps (score above zero, what was lost before it) in order; a segment is named
    by the numbers of its outer steps. Linear (Ruzzo and Tompa): each held segment points to the last one of a smaller left sum, so a search
    goes along pointers, and a segment that is passed over is never looked at again."""
    held: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, place of the last one of a smaller left sum
    total = 0.0
    for i, (gain, loss) in enumerate(steps):
        left = total - loss
        total = right = left + gain
        first, k = i, len(held) - 1
        while k >= 0 and held[k][0] >= left:
            k = held[k][4]
        while k >= 0 and held[k][1] < right:
            left, _, first, _, before = held[k]
            del held[k:]
            k = before
        held.append((left, right, first, i, k))
    return [(right - left, first, last) for left, right, first, last, _ in held]

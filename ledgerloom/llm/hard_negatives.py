"""Hard-negative mining by blocked dense matrix products.

Anchors are collected in chunks of bounded size and broadcast; candidates come as blocks of matrices, so that scores are matrix products in
float64, exact below 2^53 (see vectors). The first pass keeps the best `positives` candidates of the anchor's label per task, which a window
merges. The second sets the same blocks against a window of scores for each anchor and positive, and keeps the best `negatives` of other labels.

Defined cases: see vectors; a row with a null label takes no part; rows with the anchor's own id are no positives and, having its label
as a rule, no negatives; a repeated anchor is answered each time; an anchor without other rows of its label, or a positive without rows in its
window (always so for scores below zero), gives no rows; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import written


def _positives(sent, scale: int, k: int, first: int):
    def run(batches):
        own, of, q = sent.value
        best = V.Best(len(own), k)
        for ids, labels, c in V.blocks(batches, scale):
            for rows in V.heights(q):
                valid = (of[rows][:, None] == labels[None, :]) & (own[rows][:, None] != ids[None, :])
                best.add(rows, V.products(q[rows], c), valid, ids)
        yield best.table(first)

    return run


def _negatives(sent, scale: int, k: int, share: tuple[int, int]):
    """Percentages of the positive's score bound the window; scores are whole, so the comparisons are exact."""

    def run(batches):
        of, q, number, place, positive = sent.value  # the last three a row for each anchor and positive
        best = V.Best(len(number), k)
        ranks = [np.flatnonzero(place == r) for r in np.unique(place)]
        for ids, labels, c in V.blocks(batches, scale):
            for rows in V.heights(q):
                scores, differs = V.products(q[rows], c), of[rows][:, None] != labels[None, :]
                row_of = np.full(len(q), -1)
                row_of[rows] = np.arange(len(rows))
                for each in ranks:
                    each = each[row_of[number[each]] >= 0]
                    at = row_of[number[each]]
                    s, p = scores[at], positive[each][:, None]
                    if s.dtype == object or np.abs(positive[each].astype(float)).max(initial=0) >= V.LIMIT:
                        s, p = s.astype(object), p.astype(object)
                    inside = (share[0] * p <= 100 * s) & (100 * s <= share[1] * p)
                    best.add(each, s, differs[at] & inside.astype(bool), ids)
        yield best.table(0, number=number, place=place)

    return run


def mine(
    rows: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = V.CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Scores are inner products of floor(scale *
    component); a negative lies between share[0] and share[1] percent of the positive's score."""
    spark = rows.sparkSession
    rows = rows.where(F.col(id_col).isNotNull() & label.isNotNull())
    anchors, n, d = V.numbered(V.quantised(rows.where(is_anchor), scale, id_col, vector_col, label), "anchors")
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vec"))
    parts = []
    for first, table in V.chunked(anchors, n, d, chunk):
        own, of, q = table["vec_id"].to_numpy(), table["label"].to_numpy(), V.decoded(table["vec"], 1)[1]
        found = given.mapInArrow(_positives(spark.sparkContext.broadcast((own, of, q)), scale, positives, first), "number long, vec_id long, score long")
        best = written(V.ranked(found, ["number"], positives).withColumnRenamed("rank", "place"), "positives")
        held = best.select("number", "place", "score").toArrow()  # `positives` rows for each anchor of the chunk
        number, place, score = (held[c].to_numpy() for c in ("number", "place", "score"))
        sent = spark.sparkContext.broadcast((of, q, number - first, place, score))
        found = given.mapInArrow(_negatives(sent, scale, negatives, share), "number long, place int, vec_id long, score long").withColumn("number", F.col("number") + first)
        found = V.ranked(found, ["number", "place"], negatives).select("number", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        parts.append(written(found.join(best, ["number", "place"]), "negatives"))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    names = anchors.select("number", F.col("vec_id").alias("anchor_id"))
    out = V.together(parts).join(names, "number")
    return out.select("anchor_id", F.col("vec_id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")

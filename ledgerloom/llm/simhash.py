"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has bit i set if more than half of the hashes of its three-word shingles have it. Fingerprints at
`radius` (3) or fewer differing bits link. The 64 bits are cut into three blocks: of three differing bits one lies in some
block, so without that block at most two are left, and then there is a value within one bit (half the radius) of both.
Each distinct fingerprint thus emits, for each block left out, all variants within one bit of the rest; the variants are
shuffled and sorted, equal ones make candidate pairs, and pairs are verified by their whole fingerprints.

Copies of a fingerprint are grouped first, a bucket yields a spanning forest of its links in place of all pairs, and
components are found by star contraction over written tables.

Defined cases: a null or empty text, or one without a word, has fingerprint zero and links like any other; repeated rows
keep a row each; a null id is ignored as a component's name; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, written

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: (first bit, bits) of the three blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = _WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        j = min(n, i + (1 << 16))
        last = ends[i + width - 1 : j + width - 1] if len(words) >= width else ends[-1:]
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i:j].tolist(), last.tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and h (hash of the text), a row for each row."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "h"])

    return df.mapInArrow(run, T.StructType([df.schema["doc_id"], T.StructField("fp", T.LongType()), T.StructField("h", T.LongType())]))


def _variants(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for c, (first, bits) in enumerate(BLOCKS):
            out = np.uint64(((1 << bits) - 1) << first)
            rest = (fp & ~out) | np.uint64((c + 1) << first)
            flips = [0] + [1 << i for i in range(64) if not first <= i < first + bits]
            keys = rest[None, :] ^ np.array(flips, np.uint64)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fp, len(flips)).view(np.int64))], ["key", "fp"])


def _forest(values: np.ndarray, radius: int):
    """Edges that join the linked values of a bucket, fewer than values."""
    left = np.unique(values)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            for y in left[near]:
                yield x, y
            queue += list(left[near])
            left = left[~near]


def _collisions(radius: int):
    def pairs(keys, fps):
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        more = [e for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True) for e in _forest(fps[s : s + n], radius)]
        a = np.concatenate((a[near], np.array([x for x, _ in more], np.uint64)))
        b = np.concatenate((b[near], np.array([y for _, y in more], np.uint64)))
        e = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy().view(np.int64)), pa.array(e[:, 1].copy().view(np.int64))], ["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            held.append((k, f))
            if held[0][0][0] == k[-1]:
                continue
            k, f = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.searchsorted(k, k[-1])
            yield pairs(k[:cut], f[:cut])
            held = [(k[cut:], f[cut:])]
        if held:
            yield pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of linked fingerprints out of the distinct ones in column fp; enough of them to join each component."""
    if radius > 3:
        raise ValueError("three blocks serve a radius of 3 or less")
    variants = distinct.select("fp").mapInArrow(_variants, "key long, fp long")
    dealt = variants.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_collisions(radius), "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of docs, and fp, rep (its smallest doc_id), root (a fingerprint that names its component)."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    roots = components(links(reps, radius), "fingerprint-links")
    return fps, reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included)."""
    fps, classes = _classes(docs, id_col, text_col, radius)
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """A row of docs for each component: the smallest by id (null ids last), then by hash of its text."""
    fps, classes = _classes(docs, id_col, text_col, radius)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    # The smallest of each fingerprint first, so that copies don't meet in one place.
    least = fps.groupBy("fp").agg(F.min(place).alias("m")).join(classes, "fp").groupBy("root").agg(F.min("m").alias("m"))
    chosen = least.select(F.col("m.doc_id").alias("_id"), F.col("m.h").alias("_h"))
    rows = docs.withColumn("_text_hash", F.xxhash64(text_col))
    kept = rows.join(chosen, rows[id_col].eqNullSafe(chosen["_id"]) & (rows["_text_hash"] == chosen["_h"]), "left_semi")
    return kept.dropDuplicates([id_col, "_text_hash"]).select(docs.columns)

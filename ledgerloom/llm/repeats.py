"""Exact substring de-duplication: bytes covered by a `width`-byte string (200) that also starts elsewhere.

Every window of `width` bytes is filed under the smallest of its `GRAM`-byte grams by hash, and a run of windows with the
same smallest gram is a stretch. Equal windows are filed alike, so only stretches of grams met twice matter; equal stretches
are repeats as a whole and are counted, not compared. The distinct stretches of a gram are the shards whose windows are then
merged: all windows of a gram at one distance from it start as one interval, and each step refines the intervals by the
next eight bytes, last bytes first, as an interleave of shards is refined by the symbol before; suffixes are never sorted
anew, intervals of one are left at once, and what is left after `width` bytes are the repeated intervals (common prefixes
of at least `width`). Grams with more than `crowd` distinct stretches, which no task should hold, have the digests of
runs of windows, then of windows, counted by shuffle in place of that.

Only offsets and digests travel but for stretches that must be compared. Defined cases: a null text is empty; texts
shorter than `width` keep all; equal rows are each other's repeats; null ids pass through; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, written

GRAM = 32
UNIT = 8
#: Bytes that are hashed or merged at a time: arrays of eight bytes for each stay in a core's cache.
_SLICE = 1 << 17
_LOW = np.uint64((1 << 24) - 1)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _words(raw: bytes, count: int, shift: int = 0) -> np.ndarray:
    """The eight bytes at each of `count` places as a number."""
    return np.ndarray((count,), "<u8", raw, shift, (1,))


def _gram_hashes(raw: bytes) -> np.ndarray:
    n = len(raw) - GRAM + 1
    h = _words(raw, n) * np.uint64(_MIX[0])
    for k in (1, 2, 3):
        h = (h ^ (h >> np.uint64(31))) + _words(raw, n, 8 * k) * np.uint64(_MIX[k])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _smallest(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest (first of equal) of each `span` successive hashes."""
    n = len(h)
    padded = np.full(-(-n // span) * span, ~np.uint64(0))
    padded[:n] = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - span + 1], ahead[span - 1 : n]) & _LOW).astype(np.int64)


def _stretches(parts: list[tuple[int, int, bytes]], width: int) -> pa.RecordBatch:
    """Of (key, offset of the part in its text, bytes): gram hash, digest, key, start in the text, windows."""
    raw = b"".join(p for _, _, p in parts)
    sizes = np.fromiter((len(p) for _, _, p in parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    h = _gram_hashes(raw)
    place = _smallest(h, width - GRAM + 1)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(place)]
    at = np.flatnonzero(np.arange(len(place)) + width <= ends[part])
    gram, part = place[at], part[at]
    new = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))))
    n = np.diff(np.concatenate((new, [len(at)])))
    first, part = at[new], part[new]
    digest = xxhash.xxh3_64_intdigest
    g = np.array([digest(raw[a : a + c + width - 1]) for a, c in zip(first.tolist(), n.tolist(), strict=True)], np.uint64)
    keys = np.array([k for k, _, _ in parts], np.int64)[part]
    offsets = np.array([o for _, o, _ in parts], np.int64)[part]
    start = first - (ends - sizes)[part] + offsets
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[gram[new]].view(np.int64), g.view(np.int64), keys, start, n)], ["m", "g", "k", "start", "n"])


def stretches(docs: DataFrame, width: int) -> DataFrame:
    """m (gram), g (digest), k (key of the row), start, n (windows) of every stretch of the texts of (k, text)."""

    def run(batches):
        parts: list[tuple[int, int, bytes]] = []
        size = 0
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for o in range(0, max(1, len(raw) - width + 1), _SLICE):
                    part = raw[o : o + _SLICE + width - 1]
                    if len(part) < width:
                        continue
                    parts.append((k, o, part))
                    size += len(part)
                    if size >= _SLICE:
                        yield _stretches(parts, width)
                        parts, size = [], 0
        if parts:
            yield _stretches(parts, width)

    return docs.select("k", "text").mapInArrow(run, "m long, g long, k long, start long, n long")


def _contents(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the wanted stretches (m, g, c, d, k, start, n)."""
    lists = wanted.groupBy("k").agg(F.collect_list(F.struct("m", "g", "c", "d", "start", "n")).alias("wanted"))
    joined = _of(docs.select("k", "text"), wanted.select("k").distinct()).join(lists.hint("shuffle_hash"), "k").select("k", "text", "wanted")

    def run(batches):
        for b in batches:
            ks, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lists = b.column(2)
            counts = lists.value_lengths().to_numpy()
            table = lists.flatten()
            cols = {f: table.field(f).to_numpy() for f in ("m", "g", "c", "d", "start", "n")}
            raws = [t.encode() for t in texts]
            of = np.repeat(np.arange(len(ks)), counts)
            for i in range(0, len(of), 50_000):
                j = slice(i, i + 50_000)
                data = [raws[o][s : s + n + width - 1] for o, s, n in zip(of[j].tolist(), cols["start"][j].tolist(), cols["n"][j].tolist(), strict=True)]
                own = pa.array([ks[o] for o in of[j].tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[f][j]) for f in ("m", "c", "d")), own, pa.array(cols["start"][j]), pa.array(data, pa.binary())], ["m", "c", "d", "k", "start", "data"])

    return joined.mapInArrow(run, "m long, c long, d long, k long, start long, data binary")


def _intervals(keys: tuple[np.ndarray, ...], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of the keys (the last one first), without those that are alone, and how many are alike, one after the other."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    sizes = np.diff(np.flatnonzero(new), append=len(order))
    several = sizes > 1
    return rows[order[np.repeat(several, sizes)]], sizes[several]


def refined(raw: bytes, starts: np.ndarray, block: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows (starts in raw) share all their bytes with another of their block. Each step splits the intervals by
    the eight bytes before those compared so far and leaves out the windows that are alone. Intervals whose bytes are all alike stay as they
    are, so only the others are sorted."""
    words = _words(raw + b"\0" * 8, len(raw))
    done = np.zeros(len(starts), bool)
    live, sizes = _intervals((block,), np.arange(len(starts)))
    for step in [*range(width - 8, 0, -8), 0]:
        if not len(live):
            return done
        w = words[starts[live] + step]
        begins = np.cumsum(sizes) - sizes
        split = np.logical_or.reduceat(w != np.repeat(w[begins], sizes), begins)
        if not split.any():
            continue
        sort = np.flatnonzero(np.repeat(split & (sizes > 2), sizes))  # two that differ are alone
        part, counts = _intervals((w[sort], np.repeat(np.arange(len(sizes)), sizes)[sort]), live[sort])
        live = np.concatenate((live[np.repeat(~split, sizes)], part))
        sizes = np.concatenate((sizes[~split], counts))
    done[live] = True
    return done


def _merged(batches, width: int):
    """(k, start, end) covered by repeated windows of stretches that come sorted by gram; grams are never cut in two."""

    def solve(rows: pa.Table):
        data = rows.column("data").to_pylist()
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        windows = sizes - width + 1
        raw = b"".join(data)
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(data)), windows)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = begins[of] + inner
        # The gram is the smallest of the stretch's first window: its distance from a window tells windows apart.
        h = _gram_hashes(raw)
        m = rows.column("m").to_numpy().view(np.uint64)
        span = width - GRAM + 1
        gram = np.array([b + int(np.flatnonzero(h[b : b + span] == x)[0]) for b, x in zip(begins.tolist(), m, strict=True)], np.int64)
        m_rank = np.cumsum(np.concatenate(([0], (m[1:] != m[:-1]).astype(np.int64))))
        block = m_rank[of] * np.int64(width) + (gram[of] - starts)
        hit = refined(raw, starts, block, width) & (rows.column("c").to_numpy()[of] == 1)
        of, at = of[hit], rows.column("start").to_numpy()[of[hit]] + inner[hit]
        if not len(of):
            return
        new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1))))
        ends = np.concatenate((at[new[1:] - 1], at[-1:])) + width
        yield pa.RecordBatch.from_arrays([rows.column("k").combine_chunks().take(pa.array(of[new])), pa.array(at[new]), pa.array(ends)], ["k", "start", "end"])

    def solved(rows: pa.Table):
        """solve, by grams of about a slice."""
        m = rows.column("m").to_numpy()
        new = np.flatnonzero(m[1:] != m[:-1]) + 1
        so_far = np.cumsum(pc.binary_length(rows.column("data")).to_numpy().astype(np.int64))
        cuts = new[np.diff(so_far[new - 1] // _SLICE, prepend=0) != 0].tolist()
        for s, e in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
            yield from solve(rows.slice(s, e - s))

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size < _SLICE:
            continue
        rows = pa.Table.from_batches(held)
        m = rows.column("m").to_numpy()
        cut = int(np.searchsorted(m, m[-1]))
        if cut:
            yield from solved(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held and sum(x.num_rows for x in held):
        yield from solved(pa.Table.from_batches(held))


def _units(batches, width: int):
    """Each stretch cut into units of up to UNIT windows by their distance from the gram: two digests, place, bytes."""
    for b in batches:
        out: list[tuple] = []
        for m, data, c, k, start in zip(*(b.column(x).to_pylist() for x in ("m", "data", "c", "k", "start")), strict=True):
            gram = int(np.flatnonzero(_gram_hashes(data).view(np.int64) == m)[0])
            n = len(data) - width + 1
            i = 0
            while i < n:
                j = min(n, i + (gram - i) % UNIT + 1)
                part = data[i : j + width - 1]
                h = xxhash.xxh3_128_intdigest(part)
                out.append((h >> 64, h & (2**64 - 1), k, start + i, c, part))
                i = j
        if out:
            h = np.array([x[:2] for x in out], np.uint64).view(np.int64)
            rest = [pa.array([x[i] for x in out], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *rest], ["h1", "h2", "k", "start", "c", "data"])


def _windows(batches, width: int):
    """Two digests of every window of each unit, its place, and whether the unit is met once."""
    for b in batches:
        units = b.column("data").to_pylist()
        n = np.fromiter((len(u) - width + 1 for u in units), np.int64, len(units))
        digests = b"".join(xxhash.xxh3_128_digest(u[i : i + width]) for u, many in zip(units, n.tolist(), strict=True) for i in range(many))
        halves = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)
        of = np.repeat(np.arange(len(units)), n)
        start = b.column("start").to_numpy()[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        rest = [b.column("k").to_numpy()[of], start, b.column("once").to_numpy(zero_copy_only=False)[of]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (halves[:, 0].copy(), halves[:, 1].copy(), *rest)], ["h1", "h2", "k", "start", "once"])


def _crowded(contents: DataFrame, width: int) -> DataFrame:
    """(k, start, end) covered by repeated windows of stretches whose gram has too many for a task. Units met again are
    repeats as a whole; the windows of the distinct units are counted for the others."""
    units = written(contents.mapInArrow(lambda batches: _units(batches, width), "h1 long, h2 long, k long, start long, c long, data binary"), "stretch-units")
    kinds = units.groupBy("h1", "h2").agg(F.sum("c").alias("times"), F.min(F.struct("k", "start", "data")).alias("one"))
    kinds = written(kinds.select("h1", "h2", "times", "one.*"), "unit-kinds")
    whole = units.where("c = 1").join(kinds.where("times > 1").select("h1", "h2"), ["h1", "h2"])
    whole = whole.select("k", "start", (F.col("start") + F.octet_length("data")).cast("long").alias("end"))
    windows = kinds.withColumn("once", F.col("times") == 1).mapInArrow(lambda batches: _windows(batches, width), "h1 long, h2 long, k long, start long, once boolean")
    windows = written(windows, "unit-windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return whole.union(windows.where("once").join(twice, ["h1", "h2"]).select("k", "start", (F.col("start") + width).alias("end")))


def _small(df: DataFrame, most: int = 2_000_000) -> bool:
    return df.limit(most + 1).count() <= most


def _of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs, without those of other keys if the keys are few enough to send along; the join that follows drops the rest."""
    return docs.join(F.broadcast(keys), "k", "left_semi") if _small(keys) else docs


def covered(docs: DataFrame, width: int = 200, crowd: int = 64) -> DataFrame:
    """k and spans (start, end; bytes, maybe overlapping) of the texts of (k, text) that have repeated bytes."""
    every = written(stretches(docs, width), "stretches")
    again = written(every.groupBy("m").count().where("count > 1").select("m"), "stretch-grams")
    found = written(every.join(F.broadcast(again) if _small(again) else again.hint("shuffle_hash"), "m"), "stretches-met-again")
    dropped(every, again)
    # Any place of a stretch will do, as equal ones have the same windows; single numbers are kept by hashing, structs would be sorted.
    one = (F.min("k").alias("k"), F.min_by("start", "k").alias("start"), F.min("n").alias("n"))
    kinds = written(found.groupBy("m", "g").agg(F.count("*").alias("c"), *one), "stretch-kinds")
    whole = found.join(kinds.where("c > 1").select("m", "g").hint("shuffle_hash"), ["m", "g"])
    whole = whole.select("k", "start", (F.col("start") + F.col("n") + (width - 1)).alias("end"))
    # Where all stretches of a gram are met again, all of their windows are covered by now.
    several = kinds.groupBy("m").agg(F.count("*").alias("d"), F.min("c").alias("least")).where("d > 1 and least = 1").drop("least")
    wanted = written(kinds.join(several, "m"), "stretches-to-merge")
    contents = written(_contents(docs, wanted, width), "stretch-contents")
    apart = contents.where(F.col("d") <= crowd).repartition("m").sortWithinPartitions("m")
    merged = apart.mapInArrow(lambda batches: _merged(batches, width), "k long, start long, end long")
    crowded = _crowded(contents.where(F.col("d") > crowd), width)
    spans = whole.union(merged).union(crowded)
    return spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, spans (start, end of maximal removed runs, bytes), kept (bytes left)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    spans = written(covered(docs, width), "repeats")
    keys = spans.select("k")
    few = _small(keys)
    part = docs.join(F.broadcast(keys), "k", "left_semi") if few else docs
    joined = part.join(spans.hint("shuffle_hash"), "k", "inner" if few else "left").select("doc_id", "text", "spans")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            lists = b.column(2)
            rows = []
            for text, found in zip(b.column(1).to_pylist(), lists, strict=True):
                raw = text.encode()
                items = found.values
                runs = []
                if items is not None and len(items):
                    s, e = items.field("start").to_numpy(), items.field("end").to_numpy()
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                    runs = list(zip(s[new].tolist(), np.concatenate((e[new[1:] - 1], e[-1:])).tolist(), strict=True))
                cuts = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), [{"start": x, "end": y} for x, y in runs], kept))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(span), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long")
    schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    out = joined.mapInArrow(run, schema)
    if not few:
        return out
    rest = docs.join(F.broadcast(keys), "k", "left_anti")
    none = F.array().cast(schema["spans"].dataType)
    return out.union(rest.select("doc_id", F.octet_length("text").cast("long"), F.lit(0).cast("long"), none, F.col("text").cast("binary")))

"""LM scoring with a probabilistic suffix tree over the bytes of words.

Words are spelled out between boundary marks. The context of a word's first two symbols reaches back over its opening mark
into the last three bytes of the word before; that of later symbols stays within the word, mark included, up to `DEPTH`
bytes. A context is retained if it occurs `least` times (a fixed
count, so the tree grows with the corpus) and its next-symbol distribution diverges from that of its longest retained suffix. Each
distribution is smoothed with its suffix's (Witten-Bell), and a symbol is scored in the longest retained context. After a
boundary a text may also end, so the scores are log-probabilities of whole texts.

The tree is thus learnt from the table of distinct words with their counts and from counts of word seams (three bytes
before a word, two of its own). It is a table: depth by depth the counts meet the probabilities of their suffixes in a
shuffled join. Symbols that only held-out texts have are rows with a count of zero, so the table answers for every symbol in its
longest context, and every distinct word and seam is scored once, by joins with it: words in lists that each ask for their distinct
symbols. Texts are cut into chunks that keep a word list of their own; the lists ask the word table for counts
and scores by a shuffled join, and the answers meet their chunk again, so no table of words is held whole anywhere.

Defined cases: a null or empty text has only its end; a null id is training; repeated rows keep a row each; without
training rows every distribution is uniform; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc_mod, slices, split_words, written

DEPTH = 6
MARK, END = 0x20, 0x0A
_SYMBOL = np.int64(8)


def _packed(codes: np.ndarray) -> bytes:
    """Codes byte plane by byte plane, compressed."""
    return zstandard.compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _edges(words: pa.Array) -> np.ndarray:
    """For each word: its last three bytes, the opening mark included if it is shorter, then its first two symbols."""
    out = np.zeros(len(words), np.int64)
    for i, w in enumerate(words.to_pylist()):
        out[i] = int.from_bytes((b" " + w)[-3:]) << 16 | int.from_bytes((w + b" ")[:2])
    return out


def _seams(edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seam of every word and text end with what is before it, and the text of each."""
    n = len(bounds) - 1
    own = np.insert(edges & 0xFFFF, bounds[1:], END << 8)
    before = np.insert(edges >> 16, bounds[:-1], 0)
    return (before << 16) | own, np.repeat(np.arange(n), np.diff(bounds) + 1)


def _seam_symbols(seams: np.ndarray):
    """(context, bytes of it, symbol, seams that have it) for the first and the second symbol."""
    before, first, second = seams >> 16, (seams >> 8) & 0xFF, seams & 0xFF
    reach = (before > 0).astype(np.int64) + (before > 0xFF) + (before > 0xFFFF)
    context = (before << _SYMBOL) | MARK
    yield context, reach + 1, first, np.ones(len(seams), bool)
    yield (context << _SYMBOL) | first, reach + 2, second, first != END


def chunks(docs: DataFrame, chunk_bytes: int = 16 << 20) -> DataFrame:
    """A row per chunk (ids, places of words), one per chunk and word and one per chunk and seam (n in training, zero if only held-out texts have it)."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType().add("chunk", "long").add("word", "binary").add("place", "integer").add("n", "long").add("seam", "long").add("tokens", "binary").add("bounds", "binary")
    schema = schema.add("ids", T.ArrayType(id_type)).add("held", T.ArrayType(T.BooleanType()))
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}

    def rows(count, **columns):
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(count, t)) for k, t in kinds.items()], list(kinds))

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, chunk_bytes):
                coded, bounds = split_words(b.column(1))
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                words = coded.dictionary.cast(pa.binary())
                blank = pc.binary_length(words).to_numpy(zero_copy_only=False) == 0
                if blank.any():
                    real = ~blank[codes]
                    bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
                    codes = codes[real]
                held = b.column(2).to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(b.num_rows), np.diff(bounds))
                counts = np.bincount(codes[~held[of]], minlength=len(words)).astype(np.int64)
                seams, of = _seams(_edges(words)[codes], bounds)
                seams, where = np.unique(seams, return_inverse=True)
                times = np.bincount(where, ~held[of], len(seams)).astype(np.int64)
                name = uuid.uuid4().int >> 65
                yield rows(1, chunk=pa.array([name]), tokens=pa.array([_packed(codes)]), bounds=pa.array([bounds.astype(np.int64).tobytes()]), ids=pa.array([b.column(0).to_pylist()], kinds["ids"]), held=pa.array([held.tolist()]))
                places = np.flatnonzero(~blank)
                for i in range(0, len(places), 100_000):
                    at = places[i : i + 100_000]
                    yield rows(len(at), chunk=pa.array([name] * len(at), pa.int64()), word=words.take(pa.array(at)), place=pa.array(at.astype(np.int32)), n=pa.array(counts[at]))
                for i in range(0, len(seams), 100_000):
                    part = seams[i : i + 100_000]
                    yield rows(len(part), chunk=pa.array([name] * len(part), pa.int64()), seam=pa.array(part), n=pa.array(times[i : i + 100_000]))

    return docs.mapInArrow(run, schema)


def _spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of mark, word, mark for each word; for each symbol (all but the first marks) its place and its word."""
    words = words.cast(pa.binary())
    sizes = np.fromiter((len(w) for w in words.to_pylist()), np.int64, len(words))
    raw = np.frombuffer(b"".join(b" " + w + b" " for w in words.to_pylist()), np.uint8)
    firsts = np.cumsum(sizes + 2) - (sizes + 2)
    symbols = np.ones(len(raw), bool)
    symbols[firsts] = False
    at = np.flatnonzero(symbols)
    return raw, at, np.repeat(np.arange(len(words)), sizes + 1)


def _seen(at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How many bytes of its word, the opening mark included, come before each symbol."""
    if not len(at):
        return at
    first = np.concatenate(([True], word[1:] != word[:-1]))
    return at - (at[first] - 1)[np.cumsum(first) - 1]


def _contexts(raw: np.ndarray, at: np.ndarray, word: np.ndarray):
    """For d = 0, 1, ..: the last d bytes before each symbol as a number, and where they stay within the word."""
    seen = _seen(at, word)
    context = np.zeros(len(at), np.int64)
    for d in range(DEPTH + 1):
        if d:
            before = raw[np.maximum(at - d, 0)].astype(np.int64)
            context = context | (before << (_SYMBOL * (d - 1)))
        yield d, context, seen >= d


def events(types: DataFrame, seams: DataFrame) -> DataFrame:
    """key (depth, context, symbol), n: how often each symbol followed each context, out of (word, n) and (seam, n); n may be zero."""

    def keyed(d, context, symbol, weights):
        keys, where = np.unique((np.int64(d) << 56) | ((context & ((np.int64(1) << (_SYMBOL * d)) - 1)) << _SYMBOL) | symbol, return_inverse=True)
        n = np.bincount(where, weights, len(keys)).astype(np.int64)
        for i in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), pa.array(n[i : i + 200_000])], ["key", "n"])

    def joints(batches):
        for b in batches:
            seam, weights = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k, (context, reach, symbol, has) in enumerate(_seam_symbols(seam)):
                ends = symbol == END
                for d in range(0, 5 + k):  # depths within the word are counted with the words, but for text ends
                    use = has & (reach >= d) & ((d > k + 1) | ends)
                    yield from keyed(d, context[use], symbol[use], weights[use])

    def run(batches):
        def counted(held):
            words = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            weights = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
            raw, at, word = _spelled(words)
            symbol = raw[at].astype(np.int64)
            for d, context, within in _contexts(raw, at, word):
                yield from keyed(d, context[within], symbol[within], weights[word[within]])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 150_000:
                yield from counted(held)
                held, rows = [], 0
        if rows:
            yield from counted(held)

    found = types.select("word", "n").mapInArrow(run, "key long, n long")
    found = found.union(seams.mapInArrow(joints, "key long, n long"))
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, least: int = 2, gain: float = 4.0) -> DataFrame:
    """key, logp: log10 of the probability of each symbol of `counts` in its context, or in the longest retained suffix of it."""
    counts = counts.withColumn("d", F.shiftright("key", 56))
    levels: list[DataFrame] = []
    for d in range(DEPTH + 1):
        rows = counts.where(F.col("d") == d).select("key", "n")
        if d:
            # The same symbol in a context shorter by a byte; whatever has the one has the other.
            suffix = F.lit((d - 1) << 56).bitwiseOR(F.col("key").bitwiseAND((1 << (8 * d)) - 1))
            rows = rows.withColumn("suffix", suffix).join(levels[-1].select(F.col("key").alias("suffix"), F.col("p").alias("parent")), "suffix").drop("suffix")
        else:
            rows = rows.withColumn("parent", F.lit(1 / 256))
        # At most 256 symbols follow a context.
        of = Window.partitionBy(F.shiftright("key", 8))
        total, kinds = F.sum("n").over(of), F.count_if(F.col("n") > 0).over(of)
        rows = rows.withColumns({"total": total, "kinds": kinds})
        each = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("total") / F.col("parent"))).otherwise(0.0)
        kept = (F.col("total") >= least) & (F.sum(each).over(of) >= gain) if d else F.col("total") > 0
        smooth = (F.col("n") + F.col("kinds") * F.col("parent")) / (F.col("total") + F.col("kinds"))
        rows = rows.withColumn("kept", kept).select("key", F.when(F.col("kept"), smooth).otherwise(F.col("parent")).alias("p"))
        levels.append(written(rows, f"lm-level-{d}"))
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    return found.select("key", F.log10("p").alias("logp"))


def _key(d: np.ndarray, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return (d << 56) | ((context & ((np.int64(1) << (_SYMBOL * d)) - 1)) << _SYMBOL) | symbol


def _word_lists(batches, most: int = 200_000):
    """Of every `most` words (word, c): a row with the words and the places of their symbols in a list of distinct keys, and a row per
    key of that list. Symbols are keyed by their longest context; those that seams have are left out."""
    kinds = {"batch": pa.int64(), "key": pa.int64(), "place": pa.int32(), "words": pa.list_(pa.binary()), "c": pa.list_(pa.int64()), "codes": pa.binary(), "sizes": pa.binary()}

    def rows(count, **columns):
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(count, t)) for k, t in kinds.items()], list(kinds))

    def listed(held):
        words, c = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in (0, 1))
        raw, at, word = _spelled(words)
        *_, (_, context, _) = _contexts(raw, at, word)
        seen = _seen(at, word)
        later = seen > 2
        keys, codes = np.unique(_key(np.minimum(seen[later], DEPTH), context[later], raw[at[later]].astype(np.int64)), return_inverse=True)
        name = uuid.uuid4().int >> 65
        sizes = np.bincount(word[later], minlength=len(words)).astype("<i4")
        yield rows(1, batch=pa.array([name]), words=pa.array([words.cast(pa.binary()).to_pylist()], kinds["words"]), c=pa.array([c.to_pylist()], kinds["c"]), codes=pa.array([_packed(codes)]), sizes=pa.array([_packed(sizes)]))
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            yield rows(len(part), batch=pa.array(np.full(len(part), name)), key=pa.array(part), place=pa.array(np.arange(i, i + len(part), dtype=np.int32)))

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield from listed(held)
            held, n = [], 0
    if n:
        yield from listed(held)


def _spelled_out(left: pa.Table, right: pa.Table) -> pa.Table:
    """word, c, logp (of the symbols that its seams don't have), edge of each word of a list."""
    words, c = (left.column(n).combine_chunks().flatten() for n in ("words", "c"))
    codes, sizes = (_unpacked(left.column(n)[0].as_py()) for n in ("codes", "sizes"))
    logs = np.zeros(right.num_rows)
    logs[right.column("place").to_numpy()] = right.column("logp").to_numpy()
    total = np.bincount(np.repeat(np.arange(len(words)), sizes), logs[codes], len(words)) if len(codes) else np.zeros(len(words))
    return pa.Table.from_arrays([words, c, pa.array(total), pa.array(_edges(words))], ["word", "c", "logp", "edge"])


def _seam_keys(batches):
    for b in batches:
        seam = b.column(0).to_numpy(zero_copy_only=False)
        for context, reach, symbol, has in _seam_symbols(seam):
            yield pa.RecordBatch.from_arrays([pa.array(seam[has]), pa.array(_key(reach[has], context[has], symbol[has]))], ["of", "key"])


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, least: int = 2, gain: float = 4.0
) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held", crc_mod("doc_id", folds) == held_fold)
    n_docs = df.where("not held").count()
    cut = written(chunks(df), "lm-chunks")
    lists, texts = cut.where("word is not null").select("chunk", "word", "place", "n"), cut.where("tokens is not null")
    joints = cut.where("seam is not null").select("chunk", "seam", "n")
    seams = written(joints.groupBy("seam").agg(F.sum("n").alias("n")), "lm-seams")
    types = written(lists.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    sums = types.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, v = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    table = probabilities(written(events(types, seams), "lm-events"), least, gain)

    def scores(asked: DataFrame) -> DataFrame:
        return asked.join(table, "key").groupBy("of").agg(F.sum("logp").alias("logp"))

    spelled = written(types.select("word", F.col("n").alias("c")).mapInArrow(_word_lists, "batch long, key long, place int, words array<binary>, c array<long>, codes binary, sizes binary"), "lm-word-lists")
    found = spelled.where("key is not null").join(table, "key").select("batch", "place", "logp")
    whole = spelled.where("codes is not null").select(F.col("batch").alias("of"), "words", "c", "codes", "sizes")
    scored = written(whole.groupBy("of").cogroup(found.groupBy("batch")).applyInArrow(_spelled_out, "word binary, c long, logp double, edge long"), "lm-scored-words")
    joined = scores(seams.select("seam").mapInArrow(_seam_keys, "of long, key long")).withColumnRenamed("of", "seam")
    # Answers for words have a place; those for seams have none, and the seam as edge.
    answers = lists.select("chunk", "word", "place").join(scored, "word").select("chunk", "place", "c", "logp", "edge")
    none = F.lit(None)
    answers = answers.union(joints.select("chunk", "seam").join(joined, "seam").select("chunk", none.cast("int"), none.cast("long"), "logp", "seam"))
    schema = T.StructType(
        [T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())]
        + [T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = _unpacked(left.column("tokens")[0].as_py())
        bounds = np.frombuffer(left.column("bounds")[0].as_py(), np.int64)
        joint = right.filter(pc.is_null(right.column("place")))
        right = right.filter(pc.is_valid(right.column("place")))
        place = right.column("place").to_numpy()
        size = int(place.max()) + 1 if len(place) else 0
        c, logp, edge = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.int64)
        c[place], logp[place], edge[place] = (right.column(k).to_numpy() for k in ("c", "logp", "edge"))
        n = len(bounds) - 1
        of = np.repeat(np.arange(n), np.diff(bounds))
        base = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (v + 1)))
        total = lambda x: np.bincount(of, x[codes], n)
        seams, text = _seams(edge[codes], bounds)
        seams, where = np.unique(seams, return_inverse=True)
        # The same seams as the chunk's rows have.
        logs = joint.column("logp").to_numpy()[np.argsort(joint.column("edge").to_numpy())]
        columns = [
            left.column("ids").combine_chunks().flatten(),
            left.column("held").combine_chunks().flatten(),
            pa.array(np.diff(bounds) + 1),
            pa.array(total((c > 0).astype(float)).astype(np.int64) + int(n_docs > 0)),
            pa.array(np.full(n, n_train, np.int64)),
            pa.array(total(base(c)) + base(n_docs)),
            pa.array(total(logp) + np.bincount(text, logs[where], n)),
        ]
        return pa.Table.from_arrays(columns, [f.name for f in schema])

    asked = texts.select(F.col("chunk").alias("of"), "tokens", "bounds", "ids", "held")
    return asked.groupBy("of").cogroup(answers.groupBy("chunk")).applyInArrow(gather, schema)

"""Packing by shortest-pack-first over the length histogram.

Documents are tokenized and cut at `size` tokens; only each piece's place, length and checksum go on. The histogram of the
lengths (at most `size` bars, whatever the corpus) is packed on the driver: longest first, a length's pieces go to the
shortest packs that still have room, a run of equal packs at a time, so that packs and their counts are ranges. Pieces then
find their pack by length and rank; ranks are counted within (length, salt), so no length meets in one task.

Defined cases: a null text is empty (one end token); repeated rows are packed each; null ids pass through; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import chain, product, repeat
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, split_words, written


class Encoder:
    """Token ids of texts. Texts are cut at white space, which no token of this kind of tokenizer spans, and equal words of
    a batch are tokenized once: words of lower-case ASCII letters by the tokenizer's model, as all before it leaves them as they are, words of
    other letters many at a time, as each ends in one token with an end mark, other words one by one."""

    MARK, STOPS = "</w>", ".,;:!?"

    def __init__(self, path: str, end_id: int, held: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.held = Tokenizer.from_file(path), end_id, held
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith(self.MARK)]] = True
        self.model = self.tokenizer.model if self.bare() else None
        self.forget()

    def bare(self) -> bool:
        """Whether a word of lower-case ASCII letters comes to the model whole and unchanged."""
        given = self.tokenizer
        if any(t.content.isalpha() for t in given.get_added_tokens_decoder().values()):
            return False
        words = [ascii_lowercase, *ascii_lowercase, *map("".join, product(ascii_lowercase, repeat=2))]
        text = given.normalizer.normalize_str(" ".join(words)) if given.normalizer else " ".join(words)
        return bool(given.pre_tokenizer) and [w for w, _ in given.pre_tokenizer.pre_tokenize_str(text)] == words

    def forget(self) -> None:
        """Leaves no word known; the first lists of ids are that of no stop and those of STOPS."""
        ids, sizes = self.each(list(self.STOPS))
        self.known, self.flat, self.sizes = {}, ids, np.concatenate(([0], sizes))

    def each(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of the words, end to end, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), list(map(len, found))

    def direct(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """The same of words of lower-case ASCII letters."""
        found = list(map(self.model.tokenize, words))
        return np.array([t.id for tokens in found for t in tokens], np.uint32), list(map(len, found))

    def joined(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """The same of words of letters, tokenized as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a letter that falls apart when lower-cased, or another kind of tokenizer
            return self.each(words)
        return ids, np.diff(ends, prepend=0).tolist()

    def stems(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Each word without its full stop or comma if what is left are letters (lower-cased if they are ASCII), which stop it had (0: none), and
        whether letters are all it is."""
        if not self.last.any():  # another kind of tokenizer
            return words, np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        ends = pc.utf8_slice_codeunits(words, -1)
        stop = pc.fill_null(pc.index_in(ends, pa.array(list(self.STOPS), words.type)), -1)
        stem = pc.if_else(pc.greater_equal(stop, 0), pc.utf8_slice_codeunits(words, 0, -1), words)
        # The lower-casing of letters beyond these isn't sure to be the tokenizer's.
        letters = pc.and_(pc.utf8_is_alpha(stem), pc.match_substring_regex(stem, r"^[\x{00}-\x{24F}]*$"))
        low = pc.if_else(pc.string_is_ascii(stem), pc.ascii_lower(stem), stem)
        stops = np.where(letters.to_numpy(zero_copy_only=False), stop.to_numpy(zero_copy_only=False) + 1, 0)
        return pc.if_else(letters, low, words), stops, letters.to_numpy(zero_copy_only=False)

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has. Only words without their full stop or comma are remembered."""
        if len(self.known) > self.held:
            self.forget()
        stem, stops, letters = self.stems(words)
        coded = stem.dictionary_encode()
        stem, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        kind = np.zeros(len(stem), np.int8)
        kind[index] = letters
        if self.model:
            kind[pc.string_is_ascii(stem).to_numpy(zero_copy_only=False) & (kind == 1)] = 2
        stem = stem.to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist
        codes = np.fromiter(map(self.known.get, stem, repeat(-1)), np.int64, len(stem))
        flat, sizes = [self.flat], [self.sizes]
        new = codes < 0
        for of, run in enumerate((self.each, self.joined, self.direct)):
            todo = np.flatnonzero(new & (kind == of))
            first = sum(map(len, sizes))
            codes[todo] = np.arange(first, first + len(todo))
            for i in range(0, len(todo), 2000):  # the tokenizer's own results are large
                some = [stem[j] for j in todo[i : i + 2000].tolist()]
                ids, counts = run(some)
                self.known.update(zip(some, range(first + i, first + i + len(some)), strict=True))
                flat.append(ids)
                sizes.append(np.array(counts, np.int64))
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        # A word is its stem, then its stop.
        index = codes[index]
        return taken(self.flat, self.sizes, np.stack((index, stops), 1).ravel()), self.sizes[index] + self.sizes[stops]

    def ids(self, texts: pa.Array):
        """Yields the ids of each text, the end's included, as uint32."""
        coded, ends = split_words(texts, lower=False)
        flat, sizes = self.tokens(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids = taken(flat, sizes, index)
        bounds = np.concatenate(([0], np.cumsum(sizes[index])))[ends]
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.append(ids[s:e], np.uint32(self.end))


def taken(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The lists of these sizes, laid end to end in `flat`, that `index` asks for, end to end."""
    begins = np.cumsum(sizes) - sizes
    lengths = sizes[index]
    places = np.cumsum(lengths) - lengths
    return flat[np.arange(lengths.sum()) + np.repeat(begins[index] - places, lengths)]


def pieces(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        encoder = Encoder(path, end_id)
        for whole in batches:
            for b in slices(whole, 1, 1 << 20):
                rows = []
                for i, ids in enumerate(encoder.ids(b.column(1))):
                    for s in range(0, len(ids), size):
                        part = ids[s : s + size]
                        rows.append((i, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids)))
                table = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(table[:, 0])), *(pa.array(table[:, k + 1]) for k in range(4))], ["doc_id", *names])
        pa.default_memory_pool().release_unused()  # the worker may outlive the task

    return df.mapInArrow(run, T.StructType([df.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names)]))


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first pack, offset) of each run of equal placements: rank r of the run goes to pack
    first pack + r - first rank."""
    runs, packs, free = [], 0, []  # free: (-room, first pack, packs)
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if free and -free[0][0] >= length:
                room, first, n = heapq.heappop(free)
                take = min(n, left)
                if take < n:
                    heapq.heappush(free, (room, first + take, n - take))
                room = -room
            else:
                # New packs take several of a short length, or many documents of one length would each leave a pack almost empty.
                first, take, room = packs, -(-left // (size // length)), size
                packs += take
            runs.append((length, rank, first, size - room))
            if room > length:
                heapq.heappush(free, (length - room, first, take))
            rank += take
            left -= take
    return runs


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", salted: int = 200_000) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, path, size, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = sorted(pack_histogram(counts, size))
    table = np.array(runs, np.int64).reshape(-1, 4)
    salts = 64 + sum(counts.values()) // salted
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).alias("salt")
    cut = cut.select("*", salt)
    # One row for each length and salt: their offsets are ranges of the length's ranks.
    sums = cut.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(sums, ["length", "salt"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        keys = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(table[at, 3])], [*columns, "sequence_id", "offset"])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in ranked.select(*columns).schema.fields), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)

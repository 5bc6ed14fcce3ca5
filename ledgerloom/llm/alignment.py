"""Cross-tokenizer alignment as relations: tokens are exploded, their lengths summed by a window, and equal ends joined.

Two tokenizers read the same bytes, a space and the text. Where both end a token, the bytes are cut into groups; a token of one and
a token of the other are linked where their byte ranges overlap, which is for each stretch between neighbouring ends exactly once.

The relations hold distinct stretches of text ("units") in place of documents. A unit ends where neither tokenizer can join what stands on
both sides (`Cutter` tells from the vocabularies), so tokens, groups and links of a document are those of its units in order. Where the
vocabularies allow no such cut, a unit is a whole text.

1. Units and their counts, over all documents that can be aligned.
2. Their tokens; posexplode, windowed cumulative lengths, a full join on unit and end; running counts of common ends are group ids, and the
   last token seen from the end of the unit back is the one that covers a stretch: a range join as a merge.
3. Counts of id pairs over the corpus, the highest of each B id, and each unit's sums of them.
4. Documents as lists of units: the most frequent units, up to `hot` of bounded length, are broadcast; the rest are joined by a shuffle, in
   which no unit is frequent.

Defined cases: a text that is null or empty, or that the second tokenizer alters (it holds U+2581, or its normalizer changes it), has no
tokens: zeros and an empty digest; repeated rows count and are returned each; a null id is an id like any other; an empty table gives no
rows; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, slices, written

#: White space as byte-level pre-tokenizers know it; letters that are letters in every version of Unicode; what ends a run of them.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
MARK = r"!-@\[-`{-~"
#: White space from its first character on, unless it starts with a space or a line feed, belongs to what stands before it.
INNER = SPACE.replace(r"\t-\r ", r"\t\x0b-\r")
UNIT = re.compile(rf"[{SPACE}]*(?:[^{SPACE}{LETTER}]+|[{INNER}][{SPACE}]*|[{LETTER}]++(?![{MARK}]))*(?:[{LETTER}]++)?")
#: A space that stands before the text or after other white space, as RE2 writes it.
ODD = r"\A |[" + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", SPACE) + "] "
BLANK = "\u2581"
#: Units of at most LONG bytes may be broadcast.
HOT, LONG = 1 << 18, 64
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _bytes_of_marks() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cutter:
    """Both tokenizers, and how texts are cut into units for them. Loaded in each worker from paths."""

    def __init__(self, path_a: str, path_b: str, whole: bool = False):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        marks = _bytes_of_marks()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(marks[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        texts = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        crossing = re.compile(rf"[^{SPACE}{BLANK}][ {BLANK}]|\n|[{LETTER}][{MARK}]")
        with open(path_a, encoding="utf-8") as f:
            given = json.load(f)
        byte_level = (given.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not given.get("normalizer")
        lines = [pieces[i] for i in self.b.encode("\n")] == [BLANK, "<0x0A>"]
        self.local = byte_level and lines and not whole and not any(crossing.search(p) for p in texts)
        self.plain = self._identity(path_b)

    @staticmethod
    def _identity(path: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        return not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces

    def kept(self, text: str | None) -> bool:
        """Whether both tokenizers read exactly a space and the text."""
        if not text or BLANK in text:
            return False
        return self.plain or self.b.normalize(text).replace(BLANK, " ") == " " + text

    def units(self, spaced: str) -> list[str]:
        """The units of a text, or of a part of it from a space to before another one; joined they are the text again."""
        if not self.local or spaced[1:].isalpha():
            return [spaced]
        units = UNIT.findall(spaced)
        units.pop()  # the empty match at the end
        return units

    def tokens(self, units: list[str]) -> tuple[list, list]:
        """Ids of both tokenizers for each unit. A unit of one space, or without one in front, follows a line feed, which joins with nothing."""
        a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        spaced = [u[0] == " " and len(u) > 1 for u in units]
        b = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced, strict=True)], num_threads=1)
        return a, [ids if s else ids[2:] for ids, s in zip(b, spaced, strict=True)]


@functools.lru_cache(2)
def _cutter(path_a: str, path_b: str, whole: bool) -> Cutter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Cutter(path_a, path_b, whole)


def _parts(cutter: Cutter, texts: pa.Array) -> Iterable[tuple[list[int], list[str], np.ndarray, np.ndarray]]:
    """Documents of a batch as distinct parts: (rows, parts, part of each place, bounds of each row's places). A part runs from a space to the
    next; texts with spaces in a row, and all texts where units are whole texts, are parts as they are."""
    listed = texts.to_pylist()
    keep = np.array([cutter.kept(t) for t in listed], bool)
    odd = pc.fill_null(pc.match_substring_regex(texts, ODD), False).to_numpy(zero_copy_only=False) | (not cutter.local)
    for rows, split in ((np.flatnonzero(keep & ~odd), True), (np.flatnonzero(keep & odd), False)):
        if len(rows) and split:
            found = pc.split_pattern(texts.take(pa.array(rows)), " ")
            coded = found.flatten().dictionary_encode()
            yield rows.tolist(), [" " + p for p in coded.dictionary.to_pylist()], coded.indices.to_numpy(), found.offsets.to_numpy().astype(np.int64)
        elif len(rows):
            yield rows.tolist(), [" " + listed[r] for r in rows], np.arange(len(rows)), np.arange(len(rows) + 1)


def _unit_counts(*paths):
    def run(batches):
        cutter = _cutter(*paths)
        for batch in batches:
            for b in slices(batch, 0, 4 << 20):
                counts: Counter = Counter()
                for _, parts, at, _ in _parts(cutter, b.column(0)):
                    for units, n in zip(map(cutter.units, parts), np.bincount(at, minlength=len(parts)).tolist(), strict=True):
                        for unit in units:
                            counts[unit] += n
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["unit", "n"])

    return run


_TOKEN = "array<struct<id:int,len:int>>"


def _unit_tokens(*paths):
    def listed(ids: list[list[int]], sizes: np.ndarray) -> pa.Array:
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat), pa.array(sizes[flat])], ["id", "len"]))

    def run(batches):
        cutter = _cutter(*paths)
        sizes = [np.array([len(x) for x in table], np.int32) for table in (cutter.bytes_a, cutter.bytes_b)]
        for batch in batches:
            for b in slices(batch, 1, 1 << 20):
                units = b.column(1).to_pylist()
                a, ids = cutter.tokens(units)
                for unit, x, y in zip(units, a, ids, strict=True):
                    raw = unit.encode()
                    if b"".join(map(cutter.bytes_a.__getitem__, x)) != raw or b"".join(map(cutter.bytes_b.__getitem__, y)) != raw:
                        raise ValueError(f"the tokenizers don't give back {unit[:80]!r}; the second has to fall back to bytes")
                yield pa.RecordBatch.from_arrays([b.column(0), listed(a, sizes[0]), listed(ids, sizes[1])], ["u", "a", "b"])

    return run


def _ends(tokens: DataFrame, side: str) -> DataFrame:
    """u, the id of each token (named by its side), and the end of its bytes. Windows run where the unit was dealt."""
    rows = tokens.select("u", side).repartition("u").select("u", F.posexplode(side).alias("i", "t"))
    end = F.sum("t.len").over(Window.partitionBy("u").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("u", F.col("t.id").alias(side), end.alias("end"))


def _joined(list_col: str, separator: str):
    """The texts of a list of (end, text) structs in order of ends."""
    return F.array_join(F.transform(F.array_sort(list_col), lambda x: x["text"]), separator)


def aligned(tokens: DataFrame) -> DataFrame:
    """A row for each unit u of (u, a, b): n_a, n_b, n_groups, n_links, groups (a1,a2|b1;...) and links, an array of (a, b)."""
    ends = _ends(tokens, "a").join(_ends(tokens, "b"), ["u", "end"], "full")
    back = Window.partitionBy("u").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    rows = ends.select("u", "end", "a", "b", F.last("a", ignorenulls=True).over(back).alias("over_a"), F.last("b", ignorenulls=True).over(back).alias("over_b"), F.sum(cut).over(back).alias("g"))
    own = lambda side: F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", F.col(side).cast("string").alias("text"))))
    groups = rows.groupBy("u", "g").agg(F.max("end").alias("end"), own("a").alias("a"), own("b").alias("b"), F.collect_list(F.struct(F.col("over_a").alias("a"), F.col("over_b").alias("b"))).alias("links"))
    text = F.concat(_joined("a", ","), F.lit("|"), _joined("b", ","))
    groups = groups.select("u", F.size("a").alias("n_a"), F.size("b").alias("n_b"), "links", F.struct("end", text.alias("text")).alias("group"))
    total = lambda c: F.sum(c).cast("long")
    out = groups.groupBy("u").agg(total("n_a").alias("n_a"), total("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.flatten(F.collect_list("links")).alias("links"), F.collect_list("group").alias("group"))
    return out.select("u", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "links", _joined("group", ";").alias("groups"))


def weighted(units: DataFrame) -> DataFrame:
    """u, n_best and count_sum of units (u, n, links): a pair of ids counts as often as units with it stand in the corpus."""
    links = units.select("u", "n", F.explode("links").alias("l")).select("u", "n", "l.a", "l.b")
    pairs = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = pairs.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).cast("long"))
    pairs = written(pairs, "token-pairs")
    return links.join(pairs, ["a", "b"]).groupBy("u").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))


def _least(units: DataFrame, most: int) -> int:
    """The count from which on at most `most` units are that frequent (by steps of an eighth of a doubling)."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = dict(units.groupBy(step.alias("step")).count().collect())  # a few hundred rows
    held, least = 0, max(sizes, default=0) + 1
    for s in sorted(sizes, reverse=True):
        held += sizes[s]
        if held > most:
            break
        least = s
    return int(np.ceil(2 ** (least / 8) - 1e-9))


def _coded(sent, *paths):
    """Documents as places of broadcast units, -1 for others, which are listed; sums over the broadcast ones."""

    def run(batches):
        cutter = _cutter(*paths)
        names, sums = sent.value
        place = {u: i for i, u in enumerate(names)}
        for batch in batches:
            for b in slices(batch, 1, 1 << 20):
                n = b.num_rows
                total, codes, cold = np.zeros((n, len(SUMS)), np.int64), [None] * n, [None] * n
                for rows, parts, at, bounds in _parts(cutter, b.column(1)):
                    units = [cutter.units(p) for p in parts]
                    length = np.array([len(u) for u in units], np.int64)
                    first = np.cumsum(length) - length
                    flat = [u for x in units for u in x]
                    code = np.fromiter((place.get(u, -1) for u in flat), np.int32, len(flat))
                    before = np.concatenate(([0], np.cumsum(length[at])))
                    index = np.repeat(first[at] - before[:-1], length[at]) + np.arange(before[-1])
                    coded = code[index]
                    ends = before[bounds]
                    for r, s, e in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        codes[r] = coded[s:e]
                        miss = index[s:e][coded[s:e] < 0]
                        cold[r] = [flat[i] for i in miss.tolist()]
                        hit = coded[s:e][coded[s:e] >= 0]
                        total[r] = sums[hit].sum(0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(codes, pa.list_(pa.int32())), pa.array(cold, pa.list_(pa.string())), *(pa.array(total[:, i]) for i in range(len(SUMS)))], ["doc_id", "codes", "cold", *SUMS]
                )

    return run


def _digests(sent):
    """Digests of the groups of documents: texts of broadcast units and of those that were joined, in order."""

    def joined(codes: pa.ListArray, cold: pa.ListArray, names: pa.Array) -> list[str]:
        flat, rest = codes.flatten().to_numpy(), cold.flatten()
        at = flat.astype(np.int64)
        miss = np.flatnonzero(flat < 0)
        at[miss] = len(names) + np.arange(len(miss))
        texts = pa.concat_arrays([names, rest]).take(pa.array(at))
        bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False))))
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts), ";")
        return [hashlib.sha256(t.as_buffer()).hexdigest() if c.is_valid else "" for t, c in zip(whole, codes, strict=True)]

    def run(batches):
        names = sent.value
        for batch in batches:
            sizes = 16 * pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cold = batch.column(2)
            ends = np.concatenate(([0], np.cumsum(pc.binary_length(cold.flatten()).to_numpy(zero_copy_only=False).astype(np.int64))))
            last = np.cumsum(pc.fill_null(pc.list_value_length(cold), 0).to_numpy(zero_copy_only=False))
            sizes += np.diff(ends[last], prepend=0)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) >> 23, prepend=0)).tolist()  # some 8 MB of text at a time
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if e > s:
                    b = batch.slice(s, e - s)
                    digests = joined(b.column(1), b.column(2), names)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string()), *b.columns[3:]], ["doc_id", "groups_sha256", *SUMS])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, whole: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each document. path_a is a byte-level tokenizer, path_b a
    piece model that adds a space. whole: units are whole texts, whatever the vocabularies."""
    spark, paths = docs.sparkSession, (path_a, path_b, whole)
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_unit_counts(*paths), "unit string, n long")
    units = written(counted.groupBy("unit").agg(F.sum("n").alias("n")).withColumn("u", F.monotonically_increasing_id()), "units")
    tokens = written(units.select("u", "unit").mapInArrow(_unit_tokens(*paths), f"u long, a {_TOKEN}, b {_TOKEN}"), "unit-tokens")
    links = written(aligned(tokens).join(units.select("u", "n"), "u"), "unit-links")
    dropped(tokens)
    found = links.drop("links").join(weighted(links), "u")
    found = written(found.join(units.select("u", "unit"), "u").drop("u"), "unit-sums")
    dropped(links, units)

    least = _least(found, hot)
    frequent = (F.col("n") >= least) & (F.octet_length("unit") <= LONG)
    held = found.where(frequent).select("n", "unit", "groups", *SUMS).toArrow().sort_by([("n", "descending")])  # at most `hot` rows
    sums = np.stack([held[c].to_numpy() for c in SUMS], 1) if held.num_rows else np.zeros((0, len(SUMS)), np.int64)
    sent = spark.sparkContext.broadcast((held["unit"].to_pylist(), sums))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("cold", T.ArrayType(T.StringType())), *(T.StructField(c, T.LongType()) for c in SUMS)])
    coded = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_coded(sent, *paths), schema)
    coded = written(coded.withColumn("r", F.monotonically_increasing_id()), "coded-documents")

    rest = coded.select("r", F.posexplode("cold").alias("end", "unit")).join(found.where(~frequent), "unit")
    rest = rest.groupBy("r").agg(*(F.sum(c).alias(f"rest_{c}") for c in SUMS), F.collect_list(F.struct("end", F.col("groups").alias("text"))).alias("rest"))
    both = coded.join(rest, "r", "left")
    in_order = F.transform(F.array_sort("rest"), lambda x: x["text"])
    both = both.select("doc_id", "codes", in_order.alias("cold"), *((F.col(c) + F.coalesce(f"rest_{c}", F.lit(0))).alias(c) for c in SUMS))
    names = spark.sparkContext.broadcast(held["groups"].cast(pa.string()).combine_chunks())  # as an Arrow array, a fraction of a list of texts
    return both.mapInArrow(_digests(names), T.StructType([schema["doc_id"], T.StructField("groups_sha256", T.StringType()), *(schema[c] for c in SUMS)]))

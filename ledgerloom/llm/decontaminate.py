"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are lower-cased, cut into words and entered into one automaton; each document's words are streamed through it while
the longest match ending at each word is tracked. A word is hit if a match of `window` words (or a whole shorter item)
covers it. Documents over the coverage limit are contaminated; the spans hit can be cut from the others.

The automaton is as large as the items, so they are cut into blocks of at most `block_words` words on average, each with
an automaton of its own; documents pass the blocks one after the other, without a shuffle.

Defined cases: a null or empty text has no words and no hits; an item without words never occurs; equal item ids count
once; null ids of documents pass through; repeated rows keep a row each; an empty benchmark hits nothing; other columns
are ignored (`clean` keeps them as they are).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
Span = tuple[int, int]


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        paths = [(item, words, self._add(words)) for item, words in items if words]
        #: Items that hold the window-long strings of a state, and items that are the state's string as a whole.
        self.holds: dict[int, set[str]] = {}
        self.ends: dict[int, tuple[int, set[str]]] = {}
        for item, words, _ in paths:
            self._mark(item, words)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.short = [False] * len(self.next)
        for v in order:
            self.short[v] = v in self.ends or self.short[self.link[v]]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state for the strings of q that are no longer than p's by more than a word."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def _mark(self, item: str, words: list[bytes]) -> None:
        v = 0
        for i, w in enumerate(words):
            v = self.next[v][w]
            if i + 1 >= self.window:
                self.holds.setdefault(self._cut(v), set()).add(item)
        if len(words) < self.window:
            self.ends.setdefault(v, (len(words), set()))[1].add(item)

    def _cut(self, v: int) -> int:
        """The state of v's suffix that is a window long."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def scan(self, words: list[bytes]) -> tuple[list[Span], set[str]]:
        """Spans of words hit (sorted, merged) and the items that hit them."""
        after, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        v = n = 0
        spans: list[Span] = []
        items: set[str] = set()
        root = after[0]
        for j, w in enumerate(words):
            t = after[v].get(w)
            if t is None:
                if not v:
                    continue
                if w not in root:
                    v = n = 0
                    continue
                while t is None:
                    v = link[v]
                    t = after[v].get(w)
                n = length[v]
            n += 1
            v = t
            if n >= window:
                items |= self.holds[self._cut(v)]
                spans.append((j + 1 - window, j + 1))
            if short[v]:
                u = v
                while u > 0:
                    if u in self.ends and self.ends[u][0] <= n:
                        size, named = self.ends[u]
                        items |= named
                        spans.append((j + 1 - size, j + 1))
                    u = link[u]
        return merged(spans), items


def merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int):
    """Yields the items of a block after another, as (id as text, words)."""
    items = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    n = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-n // (6 * block_words)) or 1
    for k in range(parts):
        of = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield sorted((r["item"], words_of(r["text"])) for r in of.toLocalIterator())


def hits(docs: DataFrame, items: DataFrame, window: int = 13, item_id: str = "item_id", item_text: str = "text", text_col: str = "text", block_words: int = 200_000) -> DataFrame:
    """docs with _n_words, _items (sorted ids as text) and _spans (words hit, sorted, merged)."""
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    extra = [T.StructField("_n_words", T.LongType()), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_spans", spans_type)]
    df = docs
    for k, block in enumerate(_blocks(items, item_id, item_text, block_words)):
        auto = df.sparkSession.sparkContext.broadcast(Automaton(block, window))
        first = k == 0

        def run(batches, auto=auto, first=first):
            scan, types = auto.value.scan, (pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            for b in batches:
                found = []
                before = [(None, [], [])] * b.num_rows if first else zip(*(b.column(c).to_pylist() for c in ("_n_words", "_items", "_spans")), strict=True)
                for text, (_, named, old) in zip(b.column(text_col).to_pylist(), before, strict=True):
                    words = words_of(text)
                    spans, new = scan(words)
                    if old:
                        spans = merged([*spans, *((s["start"], s["end"]) for s in old)])
                    found.append((len(words), sorted(new.union(named)), [{"start": s, "end": e} for s, e in spans]))
                columns = [*b.columns[: b.num_columns - (0 if first else 3)], *(pa.array([f[i] for f in found], t) for i, t in enumerate(types))]
                yield pa.RecordBatch.from_arrays(columns, names)

        names = [*docs.columns, "_n_words", "_items", "_spans"]
        if k:
            df = written(df, "decontaminate")
        df = df.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))
    return df


def judge(docs: DataFrame, items: DataFrame, window: int = 13, coverage: float = 0.05, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items, spans, contaminated."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(hits(docs, items, window, **options), coverage).select("doc_id", "n_words", "n_hit", "items", "spans", "contaminated")


def _judged(found: DataFrame, coverage: float) -> DataFrame:
    least = round(1 / coverage)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.withColumn("n_hit", n_hit).withColumnsRenamed({"_n_words": "n_words", "_items": "items", "_spans": "spans"})
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (least * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, window: int = 13, coverage: float = 0.05, text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones; from the rest the spans hit are cut out."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    text = columns[docs.columns.index(text_col)]
    found = _judged(hits(docs.toDF(*columns), items, window, text_col=text, **options), coverage).where("not contaminated")

    def run(batches):
        for b in batches:
            out = [cut(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(b.column(text).to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, b.schema.field(text).type) if c == text else b.column(c) for c in columns], columns)

    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(columns, docs.schema.fields, strict=True)])
    return found.select(*columns, "spans").mapInArrow(run, schema).toDF(*docs.columns)


def cut(text: str | None, spans: list[Span]) -> str | None:
    """text without the words of the spans."""
    if not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, done = [], 0
    for s, e in spans:
        out.append(raw[done : at[s][0]])
        done = at[e - 1][1]
    return b"".join([*out, raw[done:]]).decode()

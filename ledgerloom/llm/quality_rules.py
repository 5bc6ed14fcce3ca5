"""Quality rules, line first: every line meets punctuation, navigation and boilerplate rules, failing lines go, and a
document that loses too much of its text is rejected. DataFrame functions only; nothing is shuffled.

Defined cases: a null text counts as no text (no words, so the base rule rejects it) and stays null in `cleaned`; an empty
text is cleaned to an empty text; repeated rows and null ids pass through, one output row for each input row; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

#: Phrases of page furniture; a short line with one is boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in to",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign up for",
    "subscribe to",
    "terms of service",
    "terms of use",
)

#: SQL of the three line rules over a line `l`; Spark and DuckDB read it alike.
LINE_RULES = {
    "navigation": "({seps} >= 2 AND 3 * {seps} >= {words})",
    "punctuation": "(({marks} >= 3 AND 2 * {marks} >= {words}) OR ({words} >= 40 AND {stops} = 0))",
    "boilerplate": "({words} <= 30 AND {furniture})",
}


def line_fails(l: Column) -> Column:
    """True where a line breaks a rule; a line without a word never does."""
    words = F.regexp_count(l, F.lit(WORD))
    seps = F.regexp_count(l, F.lit(r"[|»›•]"))
    marks = F.regexp_count(l, F.lit(r"[#*$%&<>!~^=]"))
    stops = F.regexp_count(l, F.lit(r"[.,;:!?]"))
    furniture = F.lower(l).rlike("|".join(BOILERPLATE))
    return (
        ((seps >= 2) & (3 * seps >= words))
        | ((marks >= 3) & (2 * marks >= words))
        | ((words >= 40) & (stops == 0))
        | ((words <= 30) & furniture)
    )


def repeated_words(words: Column, width: int = 3) -> tuple[Column, ...]:
    """Columns to apply one after another: windows sorted with their places, places of windows met twice, words covered."""
    n = F.size(words)
    windows = F.when(
        n >= width,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - width),
                lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + j) for j in range(width)]).alias("k"), i.alias("p")),
            )
        ),
    )

    def places(w: Column) -> Column:
        same = lambda i, j: F.get(w, j)["k"].eqNullSafe(F.get(w, i)["k"])
        found = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(found, lambda i: F.get(w, i)["p"]))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1), x + width) - x))
        return F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0))

    return windows, places, covered


def assess(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_lost: int = 50, carry: bool = False
) -> DataFrame:
    """One row per document: counts, base verdict, share of text lost to the line rules, cleaned text, verdict.

    A document is kept if it passes the base rule (min_words words, at most max_repeat percent of them in repeated
    three-word windows) and its failing lines hold at most max_lost percent of its characters. With carry, the whole input
    row comes along as the struct `row`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw"), text.alias("_t"), *row)
    df = df.withColumns({"_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), "_l": F.split("_t", "\n", -1)})
    windows, places, covered = repeated_words(F.col("_w"))
    df = df.withColumns(
        {
            "_s": windows,
            "_worded": F.filter("_l", lambda l: l.rlike(WORD)),
            "_keep": F.filter("_l", lambda l: ~line_fails(l)),
        }
    )
    df = df.withColumn("_p", places(F.col("_s"))).withColumn("n_repeat_words", covered(F.col("_p")).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, l: s + F.char_length(l))
    df = df.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("_l") - F.size("_keep")).cast("long").alias("n_failed_lines"),
        (total("_l") - total("_keep")).alias("lost_chars"),
        total("_l").alias("line_chars"),
        F.when(F.col("_raw").isNotNull(), F.array_join("_keep", "\n")).alias("cleaned"),
        *["row" for _ in row],
    )
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost * F.col("line_chars")))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The kept rows of docs, without the failing lines of their texts."""
    found = assess(docs, id_col, text_col, carry=True, **limits)
    # An explode, as a filter would be pushed below the steps of the assessment and repeat them for each use.
    found = found.select(F.explode(F.when(F.col("kept"), F.array(F.struct("cleaned", "row")))).alias("r"))
    return found.select(*[F.col("r.cleaned").alias(c) if c == text_col else F.col("r.row").getField(c).alias(c) for c in docs.columns])

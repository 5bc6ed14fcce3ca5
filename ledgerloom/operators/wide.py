"""Whole numbers of any length as arrays of limbs, lowest first, in base 10^9: amounts of 256 bits and their products.

Everything is an expression over arrays, so numbers stay columns: they are read from decimal or hexadecimal text, added, multiplied,
compared and summed, and written back as text. A limb times a limb and a carry fit in a long. Arrays are slow, so what is
done for every row of a table has a form over text (digits_of_hexadecimal, product, key, sum_of).
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal digits of a limb; hexadecimal digits that are read at a time.
DIGITS, NIBBLES = 9, 7
BASE = 10**DIGITS
#: Limbs of a sum: 81 digits, where 256 bits have 78.
WIDTH = 9


def _let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _div(x: Column) -> Column:
    """x // BASE, in whole numbers."""
    return F.call_function("div", x, _long(BASE))


def _none() -> Column:
    return F.array().cast("array<long>")


def _carried(limbs: Column) -> Column:
    """Limbs of any size (not below zero) brought below the base."""
    start = F.struct(_none().alias("out"), _long(0).alias("carry"))

    def step(acc, x):
        put = lambda t: F.struct(F.concat(acc["out"], F.array(t % BASE)).alias("out"), _div(t).alias("carry"))
        return _let(x + acc["carry"], put)

    return F.aggregate(limbs, start, step, lambda acc: F.concat(acc["out"], F.array(acc["carry"] % BASE, _div(acc["carry"]))))


def trimmed(limbs: Column) -> Column:
    """Without zero limbs at the top; zero is one limb. So equal numbers are equal arrays."""
    return _let(limbs, lambda a: F.slice(F.concat(a, F.array(_long(0))), F.lit(1), F.coalesce(F.array_max(F.transform(a, lambda x, i: F.when(x != 0, i + 1).otherwise(1))), F.lit(1))))


def decimal(text: Column) -> Column:
    """Limbs of decimal digits; null where the text is none."""

    def limbs(t):
        def limb(i):
            return _let(F.length(t) - (i - 1) * DIGITS, lambda end: F.substring(t, F.greatest(F.lit(1), end - DIGITS + 1), F.least(end, F.lit(DIGITS))).cast("long"))

        return F.when(t.rlike("^[0-9]+$"), F.transform(F.sequence(F.lit(1), F.ceil(F.length(t) / DIGITS).cast("int")), limb))

    return trimmed(_let(text, limbs))


def hexadecimal(text: Column) -> Column:
    """Limbs of hexadecimal digits, without a prefix; null where the text is none. Digits are read from the top, seven at a time."""

    def parts(t):
        size = F.ceil(F.length(t) / NIBBLES).cast("int")
        padded = F.lpad(t, size * NIBBLES, F.lit("0"))
        return F.when(t.rlike("^[0-9a-fA-F]+$"), F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.conv(F.substring(padded, i * NIBBLES + 1, F.lit(NIBBLES)), 16, 10).cast("long")))

    def step(acc, x):
        return _carried(F.transform(acc, lambda a, i: a * (1 << 4 * NIBBLES) + F.when(i == 0, x).otherwise(_long(0))))

    return trimmed(F.aggregate(_let(text, parts), F.array(_long(0)), step))


def add(a: Column, b: Column) -> Column:
    return trimmed(_carried(F.zip_with(a, b, lambda x, y: F.coalesce(x, _long(0)) + F.coalesce(y, _long(0)))))


def multiply(a: Column, b: Column) -> Column:
    """The product, a limb of b at a time."""

    def step(acc, x):
        row = _carried(F.transform(a, lambda y: y * x["limb"]))
        shifted = F.concat(F.array_repeat(_long(0), x["i"]), row)
        return _carried(F.zip_with(acc, shifted, lambda p, q: F.coalesce(p, _long(0)) + F.coalesce(q, _long(0))))

    places = F.transform(b, lambda limb, i: F.struct(limb.alias("limb"), i.alias("i")))
    return F.when(a.isNotNull() & b.isNotNull(), trimmed(F.aggregate(places, _none(), step)))


def order(limbs: Column) -> Column:
    """A value that sorts and compares as the number does, for min, max, ORDER BY and the like."""
    return _let(limbs, lambda a: F.when(a.isNotNull(), F.struct(F.size(a).alias("size"), F.reverse(a).alias("limbs"))))


def text(limbs: Column) -> Column:
    """The decimal digits, without leading zeros."""
    return F.array_join(F.transform(F.reverse(limbs), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), DIGITS, "0"))), "")


def total(limbs: Column, width: int = WIDTH) -> Column:
    """An aggregate: the sum of a group's numbers, a plain sum for each limb, so it combines before the shuffle. Null, as with Spark's own
    decimals, where a number has more than `width` limbs; nulls are left out, and no number at all sums to zero."""
    sums = [F.coalesce(F.sum(F.get(limbs, F.lit(i))), _long(0)) for i in range(width)]
    return F.when(F.coalesce(F.max(F.size(limbs)), F.lit(0)) <= width, trimmed(_carried(F.array(*sums))))


def _batches(f, *columns: Column) -> Column:
    """f of Python values, a batch at a time, null where any is null. Said to be nondeterministic, so that the plan calls it once a row and not
    again in each filter and column that its result stands in."""

    def run(*arrays: pa.Array) -> pa.Array:
        sys.set_int_max_str_digits(0)
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if None in r else f(*r) for r in rows], pa.string())

    udf = F.arrow_udf({1: lambda a: run(a), 2: lambda a, b: run(a, b)}[len(columns)], "string").asNondeterministic()
    return udf(*columns)


def digits_of_hexadecimal(value: Column) -> Column:
    """text(hexadecimal(value)), without arrays. Not for use inside of functions over arrays."""
    return _batches(lambda x: str(int(x, 16)), F.when(value.rlike(r"^[0-9a-fA-F]+\z"), value))


def product(a: Column, b: Column) -> Column:
    """The digits of the product of two texts of digits, null where one is none; not for use inside of functions over arrays."""
    digits = lambda c: F.when(c.rlike(r"^[0-9]+\z"), c)
    return _batches(lambda x, y: str(int(x) * int(y)), digits(a), digits(b))


def key(value: Column) -> Column:
    """Digits without leading zeros as a text that sorts as the number does; `of_key` gives them back."""
    return F.concat(F.lpad(F.length(value).cast("string"), 9, F.lit("0")), value)


def of_key(value: Column) -> Column:
    return F.substring(value, F.lit(10), F.length(value))


def sum_of(value: Column, width: int = WIDTH) -> Column:
    """An aggregate over digits without leading zeros: text(total(decimal(value))), from plain sums of nine digits each."""
    limb = lambda i: F.substring(value, F.greatest(F.lit(1), F.length(value) - (i + 1) * DIGITS + 1), F.least(F.lit(DIGITS), F.length(value) - i * DIGITS)).cast("long")
    sums = [F.coalesce(F.sum(F.when(F.length(value) > i * DIGITS, limb(i))), _long(0)) for i in range(width)]
    return F.when(F.coalesce(F.max(F.length(value)), F.lit(0)) <= width * DIGITS, text(trimmed(_carried(F.array(*sums)))))

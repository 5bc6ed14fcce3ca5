"""Causal order between transfers, and why an event is or isn't admitted after an arrival. Unknown order stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strictly_after(e, a) -> Column:
    """True, False or null (unknown): did event e happen after arrival a? Both map a field's name to a column."""
    both = lambda f: e(f).isNotNull() & a(f).isNotNull()
    return (
        F.when(e("event_id") == a("event_id"), False)
        .when(e("block") != a("block"), e("block") > a("block"))
        .when(e("tx_hash") != a("tx_hash"), e("tx_index") > a("tx_index"))
        .when(both("execution_index"), e("execution_index") > a("execution_index"))
        .when((a("kind") == "top") & e("kind").isin("internal", "erc20"), True)
        .when(e("kind") == "top", False)
        .when((e("kind") == "erc20") & (a("kind") == "erc20") & both("log_index"), e("log_index") > a("log_index"))
    )


def admission(e, a, local_end: Column, after: Column) -> Column:
    """The first reason that keeps event e from following arrival a, or CANDIDATE."""
    return (
        F.when(~e("success"), "FAILED")
        .when(e("amount_raw") == 0, "ZERO")
        .when(e("asset") != a("asset"), "OTHER_ASSET")
        .when(e("sender") != a("recipient"), "INFLOW")
        .when(e("recipient") == a("recipient"), "SELF")
        .when((e("tsec") < a("tsec")) | (e("tsec") > local_end), "OUTSIDE")
        .when(after.isNull(), "ORDER_UNRESOLVED")
        .when(~after, "NOT_AFTER")
        .otherwise("CANDIDATE")
    )


def amount_status(value: Column) -> Column:
    """Of an amount as text: digits with a sign or without, and nothing around them."""
    return (
        F.when(value.isNull() | (value == ""), "MISSING")
        .when(~value.rlike(r"^[+-]?[0-9]+\z"), "INVALID")
        .when(~value.rlike("[1-9]"), "ZERO")
        .when(value.startswith("-"), "NEGATIVE")
        .otherwise("POSITIVE")
    )

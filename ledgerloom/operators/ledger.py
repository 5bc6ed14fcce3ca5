"""Pages, journals and ledgers, replayed as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

from . import prefix

# Moves that a journal of attempts allows, and the states that block an account until they are resolved.
MOVES = {None: ("PLANNED",), "PLANNED": ("DISPATCH_INTENT",), "DISPATCH_INTENT": ("SUCCESS_VALIDATED", "UNKNOWN_TRANSPORT", "INVALID_RESPONSE"), "UNKNOWN_TRANSPORT": ("SUCCESS_VALIDATED",), "INVALID_RESPONSE": ("SUCCESS_VALIDATED",)}
UNRESOLVED = ("DISPATCH_INTENT", "UNKNOWN_TRANSPORT", "INVALID_RESPONSE")


def page_contract(pages: DataFrame, most: int = 1000) -> DataFrame:
    """Verdict on each page of a result, the first that holds; a page is compared with the one before it. Columns: result, offset, n (rows held),
    row_count (declared), total, schema, state, next_offset (null at the end), page_size."""
    by = Window.partitionBy("result").orderBy("offset")
    was = {c: F.lag(c).over(by) for c in ("next_offset", "total", "schema", "page_size")}
    first, c = F.row_number().over(by) == 1, F.col
    end = c("offset") + c("n")
    differs = lambda f: ~first & (was[f] != c(f))
    verdict = (
        F.when(~c("page_size").between(1, most), "PAGE_LIMIT")
        .when(F.when(first, c("offset") != 0).otherwise(~was["next_offset"].eqNullSafe(c("offset"))), "NONCONTIGUOUS")
        .when(differs("page_size"), "PAGE_SIZE_CHANGED")
        .when(c("state") != "QUERY_STATE_COMPLETED", "INCOMPLETE_STATE")
        .when(c("n") > c("page_size"), "EXCEEDS_LIMIT")
        .when(c("row_count") != c("n"), "ROW_COUNT")
        .when(differs("total"), "TOTAL_CHANGED")
        .when(differs("schema"), "SCHEMA_CHANGED")
        .when(end > c("total"), "EXCEEDS_TOTAL")
        .when(c("next_offset").isNotNull() & ((c("n") == 0) | (c("next_offset") != end)), "CURSOR")
        .when((end == c("total")) & c("next_offset").isNotNull(), "TERMINAL_CONTINUES")
        .when((end < c("total")) & (c("next_offset").isNull() | (c("n") == 0)), "MISSING_CONTINUATION")
        .otherwise("OK")
    )
    return pages.select("result", "offset", verdict.alias("verdict"))


def link_verdict(url: Column, host: str, path: str, allowed: tuple[str, ...]) -> Column:
    """Whether a continuation link keeps to its origin, its path (a pattern) and the parameters allowed."""
    query = F.parse_url(url, F.lit("QUERY"))
    extra = F.array_except(F.map_keys(F.str_to_map(F.coalesce(query, F.lit("")), F.lit("&"), F.lit("="))), F.array(*map(F.lit, ("", *allowed))))
    return (
        F.when(url.isNull(), "NONE")
        .when(~F.coalesce(F.parse_url(url, F.lit("HOST")).endswith(host), F.lit(False)), "ORIGIN")
        .when(~F.parse_url(url, F.lit("PATH")).rlike(path), "PATH")
        .when(F.size(extra) > 0, "PARAMETERS")
        .otherwise("OK")
    )


def journal_state(transitions: DataFrame) -> DataFrame:
    """The last state of each attempt, and how often it changed."""
    return transitions.groupBy("attempt").agg(F.max_by("state", "n").alias("state"), F.count("*").alias("changes"))


def journal_steps(transitions: DataFrame) -> DataFrame:
    """transitions with legal: whether each move is allowed after the one before it."""
    before = F.lag("state").over(Window.partitionBy("attempt").orderBy("n"))
    legal = F.lit(False)
    for was, to in MOVES.items():
        legal = legal | ((before.isNull() if was is None else before == was) & F.col("state").isin(*to))
    return transitions.withColumn("legal", F.coalesce(legal, F.lit(False)))


def snapshot(jobs: DataFrame, caps: DataFrame) -> DataFrame:
    """Per unit: spent, reserved where nothing is spent yet, what is left of the lesser of cap and allowance (unknown while the allowance is),
    whether that is overrun, and whether a job spent more than it reserved. jobs: unit, reserved, actual; caps: unit, cap, allowance."""
    sums = jobs.groupBy("unit").agg(
        F.coalesce(F.sum("actual"), F.lit(0)).alias("spent"),
        F.coalesce(F.sum(F.when(F.col("actual").isNull(), F.col("reserved"))), F.lit(0)).alias("held"),
        (F.count_if(F.col("actual") > F.col("reserved")) > 0).alias("exceeded"),
    )
    effective = F.when(F.col("allowance").isNotNull(), F.least("cap", "allowance"))
    left = effective - F.col("spent") - F.col("held")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    df = caps.join(sums, "unit", "left").withColumns({"spent": zero("spent"), "held": zero("held"), "exceeded": F.coalesce("exceeded", F.lit(False))})
    return df.select("unit", "spent", "held", F.when(left.isNotNull(), F.greatest(left, F.lit(0))).alias("remaining"), F.coalesce(left < 0, F.lit(False)).alias("overrun"), "exceeded")


def settled(jobs: DataFrame) -> DataFrame:
    """Jobs (unit, n, reserved, actual) with outcome, n being their order over all units: once one has spent more than it reserved, the stage
    is halted, and no unit takes another."""
    first = jobs.where("actual > reserved").agg(F.min("n").alias("_halt"))  # one row
    at = F.col("_halt")
    outcome = F.when(F.col("n") > at, "REFUSED").when(F.col("n") == at, "EXCEEDED").when(F.col("actual").isNull(), "RESERVED").otherwise("SETTLED")
    return jobs.join(F.broadcast(first)).withColumn("outcome", outcome).drop("_halt")


def admitted(jobs: DataFrame, caps: DataFrame) -> DataFrame:
    """Jobs (unit, n, amount) with outcome and left: each is reserved, in order of n, if it fits into what is left of its unit, and else refused and
    takes nothing. caps: unit, cap, allowance; what is left at first is the lesser, or unknown while the allowance is, and then all are refused.
    Amounts are whole and not below zero; n is unique in a unit.

    With 2^k <= left < 2^(k+1), jobs below 2^k all fit and those of 2^(k+1) or more don't; of the rest the first that fits leaves less than
    2^k. So a phase is a running total of the small ones up to the first job after which less than 2^k is left, and each unit has at most
    one phase for each bit of its cap, however many jobs it has. Running totals go by ranges (see prefix), so no unit meets in one task."""
    left = F.when(F.col("allowance").isNotNull(), F.greatest(F.least("cap", "allowance"), F.lit(0)))
    ranged = prefix.dealt(jobs.select("unit", "n", "amount").withColumn("_bits", F.when(F.col("amount") > 0, F.length(F.bin("amount"))).otherwise(0)), ["unit"], ["n"])
    sums = stored(ranged.groupBy("unit", "_range", "_bits").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("_sum")), "range-sums")
    state = stored(caps.select("unit", left.alias("left"), F.lit(None).cast("long").alias("after"), F.lit(-1).alias("at")), "admission")
    phases = state.where("left is null").select("unit", "after", F.lit(None).cast("long").alias("until"), "left", F.lit(None).cast("long").alias("bit"), F.lit(None).cast("long").alias("taken"))
    parts = [phases]
    places = (F.length(F.bin("left")) - 1).cast("int")
    bit = F.when(F.col("left") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), places)).otherwise(F.lit(0).cast("long"))
    so_far = F.sum("_sum").over(Window.partitionBy("unit").orderBy("_range").rangeBetween(Window.unboundedPreceding, 0))
    while True:
        open_ = state.where("left is not null").withColumns({"bit": bit, "places": places})
        # A phase is over at the latest in the first range after whose small jobs too little is left; later ranges aren't read.
        small_sums = sums.join(F.broadcast(open_), "unit").where("left > 0 and _range > at and _bits <= places").withColumn("so_far", so_far)
        latest = small_sums.where(F.col("left") - F.col("so_far") < F.col("bit")).groupBy("unit").agg(F.min("_range").alias("latest"))
        open_ = stored(open_.join(latest, "unit", "left").withColumn("latest", F.coalesce("latest", F.lit(2**31 - 1))), "open-units")
        low, high, most = open_.agg(F.min("at"), F.max("latest"), F.max("places")).first()
        if low is None:
            break
        near = ranged.where((F.col("_range") >= low) & (F.col("_range") <= high) & (F.col("_bits") > 0) & (F.col("_bits") <= most + 1))
        rows = near.join(F.broadcast(open_), "unit").where("left > 0 and _range between at and latest and (after is null or n > after) and _bits <= places + 1")  # a row per unit is broadcast
        rows = prefix.in_ranges(rows.withColumn("small", F.when(F.col("_bits") <= F.col("places"), F.col("amount")).otherwise(F.lit(0).cast("long")).cast("decimal(19,0)")), ["unit"], ["n"], "small", "total")
        rest = F.col("left") - F.col("total")
        big = F.col("_bits") > F.col("places")
        ends = F.when(big, F.when(F.col("amount") <= rest, rest - F.col("amount"))).otherwise(F.when(rest < F.col("bit"), rest))
        ended = rows.withColumn("next", ends.try_cast("long")).where("next is not null").groupBy("unit").agg(F.min_by(F.struct("n", "next", "_range", F.when(big, F.col("n")).alias("taken")), "n").alias("e"))
        done = stored(open_.join(ended, "unit", "left").select("unit", "after", F.col("e.n").alias("until"), "left", "bit", F.col("e.taken").alias("taken"), F.col("e.next").alias("next"), F.col("e._range").alias("at")), "phases")
        parts.append(done.drop("next", "at"))
        state = done.where("until is not null").select("unit", F.col("next").alias("left"), F.col("until").alias("after"), "at")
    phases = parts[0]
    for p in parts[1:]:
        phases = phases.unionByName(p)
    at = (F.col("after").isNull() | (F.col("n") > F.col("after"))) & (F.col("until").isNull() | (F.col("n") <= F.col("until")))
    fits = F.col("left").isNotNull() & ((F.col("amount") == 0) | (F.col("amount") < F.col("bit")) | F.coalesce(F.col("n") == F.col("taken"), F.lit(False)))
    met = jobs.join(F.broadcast(phases), "unit").where(at)  # a phase for each bit of a unit's cap, at most
    return met.select(*jobs.columns, F.when(fits, "RESERVED").otherwise("REFUSED").alias("outcome"))


def risk_buckets(jobs: DataFrame, cap: int) -> DataFrame:
    """Per bucket: what its jobs may cost (actual where known, else reserved), split by how final that is, and what is left of the cap.
    jobs: bucket, reserved, actual, known (execution), upper (a bound on the rest, or null)."""
    risk = F.coalesce("actual", "reserved")
    where = lambda on: F.coalesce(F.sum(F.when(on, risk)), F.lit(0).cast("long"))
    known = F.col("actual").isNotNull()
    df = jobs.groupBy("bucket").agg(
        F.sum(risk).alias("risk"),
        F.coalesce(F.sum("known"), F.lit(0).cast("long")).alias("known_execution"),
        where(known).alias("final_actual"),
        where(~known & F.col("upper").isNotNull()).alias("bounded_not_final"),
        where(~known & F.col("upper").isNull()).alias("unknown_reserved"),
    )
    return df.withColumn("remaining", F.greatest(F.lit(cap) - F.col("risk"), F.lit(0)))


def export_envelope(results: DataFrame, observed: DataFrame, page_size: int) -> DataFrame:
    """An upper bound, in whole credits, on exporting each result: the dearer of the byte and the datapoint scheme by all that was observed, rounded
    up for each page. results: result, rows, bytes, columns; observed: result, bytes, datapoints (either may be null)."""
    most = observed.groupBy("result").agg(F.max("bytes").alias("b"), F.max("datapoints").alias("d"))
    df = results.join(most, "result", "left")
    up = lambda n, d: F.floor((n + (d - 1)) / d)  # noqa: E731  # ceiling of whole numbers
    size = F.greatest("bytes", F.coalesce("b", F.lit(0)))
    points = F.greatest(F.col("rows") * F.col("columns"), F.coalesce("d", F.lit(0)), up(size, 100))
    pages = F.greatest(F.lit(1), up(F.col("rows"), page_size))
    per_page = F.greatest(F.lit(1), up(size * 20, 1_000_000), up(points, 1000))
    return df.select("result", size.alias("bytes"), points.alias("datapoints"), pages.alias("pages"), per_page.alias("per_page"), (per_page * pages).alias("credits"))


def running_balance(moves: DataFrame, most: int = prefix.MOST_ROWS) -> DataFrame:
    """Balance of each account and asset after every move, in causal order; a hub of over `most` moves is summed over ranges of them."""
    moves = moves.withColumn("_change", F.col("sign") * F.col("amount"))
    return prefix.total_so_far(moves, ["account", "asset"], ["ord", "sign"], "_change", "balance", most).drop("_change")


def known_balance(moves: DataFrame, openings: DataFrame) -> DataFrame:
    """Balances after each move from an opening one (account, asset, opening) that may be unknown: unknown stays unknown, an account that isn't
    listed is unknown too, and what is known to go below zero is an OVERSPENT state. moves: account, asset, ord, sign, amount."""
    df = running_balance(moves).join(openings, ["account", "asset"], "left")
    after = F.col("opening") + F.col("balance")
    return df.select("account", "asset", "ord", "sign", after.alias("actual"), F.when(after.isNull(), "UNKNOWN").when(after < 0, "OVERSPENT").otherwise("KNOWN").alias("state"))

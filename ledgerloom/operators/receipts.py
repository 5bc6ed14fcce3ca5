"""Rows of an index matched with the logs of receipts, one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

from . import prefix, wide

# The topic of a token transfer, and why a row or a log is no event.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
NO_RECEIPT, NO_SUCCESS, DUPLICATE, MULTIPLICITY, UNREAD = (
    "RECEIPT_DETAIL_UNAVAILABLE", "TOKEN_RECEIPT_NOT_SUCCESSFUL", "DUPLICATE_RECEIPT_LOG_INDEX", "INDEX_RECEIPT_TRANSFER_MULTIPLICITY_MISMATCH", "RECEIPT_LOG_PARSE_FAILED",
)


def paired(left: DataFrame, right: DataFrame, key: list[str], left_order: str, right_order: str) -> DataFrame:
    """A multiset join: the first row of a key on one side with the first on the other, the second with the second, and so on; what is left over on
    either side stays, unmatched. Rows of a key of over a million are numbered over ranges (see prefix), so a key may hold any share of them; the join is by key and
    number, of which no two rows of a side have the same. Keys must not be null; other columns of the sides have different names."""
    number = lambda df, order: prefix.total_so_far(df.withColumn("_one", F.lit(1).cast("long")), key, [order], "_one", "_nth").drop("_one")
    return number(left, left_order).join(number(right, right_order), [*key, "_nth"], "full").withColumnRenamed("_nth", "nth")


def transfer_logs(logs: DataFrame) -> DataFrame:
    """Token transfers among logs (tx, place, address, topics, data, log_index, removed): contract, sender, recipient and value as
    digits, and gap where a log of that form can't be read. Others aren't returned."""
    topic = lambda i: F.get("topics", F.lit(i))
    form = (F.size("topics") == 3) & (F.lower(topic(0)) == TRANSFER) & ~F.coalesce("removed", F.lit(False)) & (F.length(topic(1)) == 66) & (F.length(topic(2)) == 66) & (F.length("data") == 66)
    account = lambda i: F.lower(F.concat(F.lit("0x"), F.right(topic(i), F.lit(40))))
    df = logs.where(F.coalesce(form, F.lit(False))).select(
        "tx", "place", F.lower("address").alias("contract"), account(1).alias("sender"), account(2).alias("recipient"),
        wide.digits_of_hexadecimal(F.regexp_extract("data", "^0x([0-9a-fA-F]+)$", 1)).alias("value"), "log_index",
    )
    return df.withColumn("gap", F.when(F.col("contract").isNull() | F.col("value").isNull() | F.col("log_index").isNull(), UNREAD))


def token_events(rows: DataFrame, receipts: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (tx, log_index, and the row_id whose place among equal rows is the log's among equal logs, null for a log too many) and gaps (tx,
    reason, contract, sender, recipient, value, rows, logs). rows: row_id, tx, contract, sender, recipient, value; receipts: tx, status. A log
    counts if its key is that of a row; of equal log indexes of a transaction the first in place counts. row_id and place are unique in a
    transaction."""
    key = ["tx", "contract", "sender", "recipient", "value"]
    known = rows.join(receipts.select("tx", F.col("status")), "tx", "left")
    none = lambda df, reason: df.select("tx", F.lit(reason).alias("reason"), *[F.lit(None).cast("string").alias(k) for k in key[1:]], F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("logs"))
    lacking = receipts.select("tx", F.lit(True).alias("_there"))
    absent = rows.select("tx").distinct().join(lacking, "tx", "left_anti")
    failed = known.where("status is not null and status <> 1").select("tx").distinct()
    asked = stored(known.where("status = 1").drop("status"), "index-rows")
    read = stored(transfer_logs(logs.join(asked.select("tx"), "tx", "left_semi")), "transfer-logs")
    listed = read.where("gap is null").join(asked.select(*key), key, "left_semi")
    first = F.min("place").over(Window.partitionBy("tx", "log_index"))
    listed = stored(listed.withColumn("first", F.col("place") == first), "counted-logs")
    counted, twice = listed.where("first"), listed.where("not first")
    met = stored(paired(asked.select("row_id", *key), counted.select(*key, "log_index"), key, "row_id", "log_index"), "paired-logs")
    sums = met.groupBy(*key).agg(F.count("row_id").alias("rows"), F.count("log_index").alias("logs")).where("rows <> logs")
    gaps = none(absent, NO_RECEIPT).unionByName(none(failed, NO_SUCCESS)).unionByName(none(twice, DUPLICATE)).unionByName(none(read.where("gap is not null"), UNREAD))
    gaps = gaps.unionByName(sums.select("tx", F.lit(MULTIPLICITY).alias("reason"), *key[1:], "rows", "logs"))
    return met.where("log_index is not null").select("tx", "log_index", "row_id", *key[1:]), gaps


def bound_logs(receipt: DataFrame, frames: DataFrame, most: int = prefix.MOST_ROWS) -> DataFrame:
    """Logs of receipts (tx, log_index, address, topics, data) with the call frames that emitted them (tx, path, address, topics, data), by
    transaction, address, topics and data. bound: LOG where the frame's log says which index it has or it is the only one of its kind in the
    transaction, AMBIGUOUS where equal logs can't be told apart, RECEIPT_ONLY and FRAME_ONLY where the other side lacks it. Both sides are one
    table, dealt once by key, and the n-th log of a key stands with its n-th frame; keys of over `most` rows are paired over ranges."""
    key = ["tx", "address", "topics", "data"]
    plain = lambda df: df.withColumns({"address": F.lower("address"), "data": F.lower("data"), "topics": F.lower(F.array_join("topics", ","))})
    logs, calls = plain(receipt).select(*key, "log_index"), plain(frames).select(*key, "path")
    both = logs.withColumn("_log", F.lit(True)).unionByName(calls.withColumn("_log", F.lit(False)), allowMissingColumns=True).where(" and ".join(f"{k} is not null" for k in key))
    large = prefix.large_groups(both, key, most)
    small = (both if large is None else both.join(large, key, "left_anti")).repartition(*key)
    whole = Window.partitionBy(*key)
    counts = {"n": F.count_if("_log").over(whole), "m": F.count_if(~F.col("_log")).over(whole)}
    numbered = small.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "_log").orderBy("log_index", "path"))).withColumns(counts)
    met = numbered.groupBy(*key, "nth").agg(*(F.max(c).alias(c) for c in ("log_index", "path", "n", "m"))).select("tx", "log_index", "path", "n", "m")
    if large is not None:
        logs, calls = (stored(df.join(large, key, "left_semi"), name) for df, name in ((logs, "logs"), (calls, "frame-logs")))
        counts = logs.groupBy(*key).agg(F.count("*").alias("n")).join(calls.groupBy(*key).agg(F.count("*").alias("m")), key, "full")
        hot = paired(logs, calls, key, "log_index", "path").join(stored(counts, "log-counts"), key)
        met = met.unionByName(hot.select(*met.columns))
    bound = F.when(F.col("path").isNull(), "RECEIPT_ONLY").when(F.col("log_index").isNull(), "FRAME_ONLY").when((F.col("n") == 1) & (F.col("m") == 1), "LOG").otherwise("AMBIGUOUS")
    return met.select("tx", "log_index", "path", bound.alias("bound"))

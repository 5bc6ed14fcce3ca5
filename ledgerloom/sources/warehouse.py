"""Raw chain tables (transactions, traces, token transfers) and requested intervals, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import read

#: Seconds of block zero and between blocks.
GENESIS, STEP = 1_600_000_000, 12
BLOCKS = 300  # length of a requested interval


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of accounts: a row, broadcast."""
    return F.broadcast(read(spark, sf_dir, "customer").agg(F.count("*").alias("accounts")))


def _place(key: str) -> list[Column]:
    block = F.floor(F.col(key) / 4)
    second = F.lit(GENESIS) + block * STEP
    return [F.col(key).alias("tx_hash"), block.alias("block"), (F.col(key) % 4).alias("tx_index"), second.alias("tsec"), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int")).alias("block_date")]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").join(_customers(spark, sf_dir))
    return orders.select(
        *_place("o_orderkey"),
        F.col("o_custkey").alias("sender"),
        ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % F.col("accounts")).alias("recipient"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"),
        (F.col("o_orderstatus") != "P").alias("success"),
        (21_000 + F.col("o_orderkey") % 1000).alias("gas_used"),
        (F.col("o_orderkey") % 50 + 1).alias("gas_price"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(_customers(spark, sf_dir))
    path = F.expr("element_at(array('', '0', '1', '0_0', '0_1', '1_0', '0_0_1'), l_linenumber)")
    return lines.select(
        *_place("l_orderkey"),
        (F.col("l_suppkey") % F.col("accounts")).alias("sender"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") % F.col("accounts")).alias("recipient"),
        ((F.col("l_partkey") + 1) % F.col("accounts")).alias("address"),
        F.when(F.col("l_returnflag") == "R", (F.col("l_suppkey") + 5) % F.col("accounts")).alias("refund_address"),
        F.when(F.col("l_tax") > 0, F.round(F.col("l_extendedprice") * 100)).otherwise(0).cast("long").alias("amount"),
        path.alias("path"),
        (F.col("l_discount") < 0.085).alias("success"),
        (F.col("l_orderkey") % 10 != 0).alias("tx_success"),
        F.when(F.col("l_returnflag") == "R", "suicide").otherwise("call").alias("type"),
        F.when(F.col("l_partkey") % 5 == 0, "delegatecall").when(F.col("l_partkey") % 5 != 1, "call").alias("call_type"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 25").join(_customers(spark, sf_dir))
    return lines.select(
        *_place("l_orderkey"),
        (F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).cast("long").alias("log_index"),
        (F.col("l_partkey") % 3).alias("contract"),
        (F.col("l_partkey") % F.col("accounts")).alias("sender"),
        (F.col("l_suppkey") * 3 % F.col("accounts")).alias("recipient"),
        F.col("l_quantity").cast("long").alias("amount"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requested interval per customer: its account, a range of blocks with their seconds, for some only one token."""
    start = F.col("c_custkey") * 7 % 3000
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("interval_id"),
        F.col("c_custkey").alias("account"),
        F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 3).alias("contract"),
        start.alias("start_block"),
        (start + BLOCKS).alias("end_block"),
        (GENESIS + start * STEP).alias("start_time"),
        (GENESIS + (start + BLOCKS) * STEP).alias("end_time"),
    )


_PLACE_SQL = f"{{0}} AS tx_hash, {{0}} // 4 AS block, {{0}} % 4 AS tx_index, {GENESIS} + {{0}} // 4 * {STEP} AS tsec, CAST(to_timestamp({GENESIS} + {{0}} // 4 * {STEP}) AT TIME ZONE 'UTC' AS DATE) AS block_date"

#: The same in DuckDB, as tables of a WITH clause.
WAREHOUSE_SQL = f"""acc AS (SELECT count(*) AS accounts FROM customer),
transactions AS (SELECT {_PLACE_SQL.format("o_orderkey")}, o_custkey AS sender, (o_custkey * 31 + o_orderkey) % accounts AS recipient, CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
  o_orderstatus <> 'P' AS success, 21000 + o_orderkey % 1000 AS gas_used, o_orderkey % 50 + 1 AS gas_price FROM orders, acc),
traces AS (SELECT {_PLACE_SQL.format("l_orderkey")}, l_suppkey % accounts AS sender, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % accounts END AS recipient, (l_partkey + 1) % accounts AS address,
  CASE WHEN l_returnflag = 'R' THEN (l_suppkey + 5) % accounts END AS refund_address, CASE WHEN l_tax > 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END AS amount,
  ['', '0', '1', '0_0', '0_1', '1_0', '0_0_1'][l_linenumber] AS path, l_discount < 0.085 AS success, l_orderkey % 10 <> 0 AS tx_success, CASE WHEN l_returnflag = 'R' THEN 'suicide' ELSE 'call' END AS type,
  CASE WHEN l_partkey % 5 = 0 THEN 'delegatecall' WHEN l_partkey % 5 <> 1 THEN 'call' END AS call_type FROM lineitem, acc),
tokens AS (SELECT {_PLACE_SQL.format("l_orderkey")}, l_linenumber * 10 + l_partkey % 10 AS log_index, l_partkey % 3 AS contract, l_partkey % accounts AS sender, l_suppkey * 3 % accounts AS recipient,
  CAST(l_quantity AS BIGINT) AS amount FROM lineitem, acc WHERE l_quantity > 25),
intervals AS (SELECT c_custkey AS interval_id, c_custkey AS account, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 3 END AS contract, c_custkey * 7 % 3000 AS start_block, c_custkey * 7 % 3000 + {BLOCKS} AS end_block,
  {GENESIS} + c_custkey * 7 % 3000 * {STEP} AS start_time, {GENESIS} + (c_custkey * 7 % 3000 + {BLOCKS}) * {STEP} AS end_time FROM customer)"""

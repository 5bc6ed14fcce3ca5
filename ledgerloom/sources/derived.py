"""Transfers, facts, label observations and result pages, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer per event. Accounts are users; several transfers share a transaction."""
    events = read(spark, sf_dir, "events")
    users = events.agg(F.count_distinct("user_id")).first()[0]  # looked up once, as a loop scans transfers again and again
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    df = events.withColumn("tsec", second)
    return df.select(
        "event_id",
        F.col("user_id").alias("sender"),
        (F.get_json_object("props", "$.k").cast("long") % F.lit(users)).alias("recipient"),
        F.round(F.col("value") * 100).cast("long").alias("amount_raw"),
        "tsec",
        F.floor(F.col("tsec") / 7200).alias("block"),
        (F.floor(F.col("tsec") / 1800) % 4).alias("tx_index"),
        F.floor(F.col("tsec") / 1800).alias("tx_hash"),
        F.lit(None).cast("long").alias("execution_index"),
        (F.col("event_id") % 50).alias("log_index"),
        F.when(F.col("event_type") == "purchase", "erc20").when(F.col("event_type") == "click", "internal").otherwise("top").alias("kind"),
        (F.col("event_id") % 2).alias("asset"),
        (F.col("event_type") != "error").alias("success"),
    )


#: The same in DuckDB, as the first table of a WITH clause.
TRANSFERS_SQL = """transfers AS (SELECT event_id, user_id AS sender, CAST(json_extract_string(props, '$.k') AS BIGINT) % (SELECT count(DISTINCT user_id) FROM events) AS recipient,
  CAST(round(value * 100) AS BIGINT) AS amount_raw, CAST(floor(epoch(ts)) AS BIGINT) AS tsec, CAST(floor(floor(epoch(ts)) / 7200) AS BIGINT) AS block,
  CAST(floor(floor(epoch(ts)) / 1800) AS BIGINT) % 4 AS tx_index, CAST(floor(floor(epoch(ts)) / 1800) AS BIGINT) AS tx_hash, event_id % 50 AS log_index,
  CASE event_type WHEN 'purchase' THEN 'erc20' WHEN 'click' THEN 'internal' ELSE 'top' END AS kind, event_id % 2 AS asset, event_type <> 'error' AS success FROM events)"""

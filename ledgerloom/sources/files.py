"""Tables from and to files: delimited and JSON text, compressed or not, with a digest of what was read or written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a .csv or .json file (.gz or not) as text columns; a byte order mark at the start is no part of a name."""
    bare = path.removesuffix(".gz")
    if bare.endswith(".csv"):
        df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    elif bare.endswith(".json"):
        df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    else:
        raise ValueError(f"neither .csv nor .json: {path}")
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, size and sha256 of each file, read by Spark, so wherever the path is."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """path and verdict (OK, SIZE, CHANGED, NOT_LISTED, MISSING) of files against a manifest (path, size, sha256)."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("sha256").alias("m_sha"))
    both = contents(spark, path).join(m, "path", "full")
    c = F.col
    verdict = F.when(c("size").isNull(), "MISSING").when(c("m_size").isNull(), "NOT_LISTED").when(c("size") != c("m_size"), "SIZE").when(c("sha256") != c("m_sha"), "CHANGED").otherwise("OK")
    return both.select("path", verdict.alias("verdict"))


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for; nested values as JSON text, missing columns empty."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """Compressed CSV with a header, rows in order across its files; Spark's commit puts all of it in place or none."""
    flat(df, columns).orderBy(*order).write.mode("error").csv(path, header=True, compression="gzip")


def write_snapshot(df: DataFrame, path: str, version: str) -> None:
    """A version of a table as its partition; earlier versions stay, the same version is replaced whole."""
    df.withColumn("snapshot_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_version").parquet(path)


def content_id(df: DataFrame, columns: list[str]) -> str:
    """A digest of a table that neither the order nor the partitions of its rows change: the digests of its rows, summed."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(38,0)")) for i in (1, 13, 25, 37)]
    got = df.agg(F.count("*"), *parts).first()
    return "-".join(str(x or 0) for x in got)

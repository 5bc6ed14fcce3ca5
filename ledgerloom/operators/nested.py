"""Walks through nested JSON of any depth, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import Run

# Fields that hold a block's hash, and those that name an account.
BLOCK_HASH = ("blockHash", "block_hash")
ACCOUNTS = ("address", "sender", "recipient", "from_address", "to_address", "target_address", "seed_from", "seed_to")


def leaves(texts: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, path ($.a[0].b), key (the name of the nearest field, null for an item of a list) and value (as text, null for a JSON null) of all that
    is no object and no list. A level of nesting is an explode of variants; the last is where none is left. A text that is no JSON has no rows."""
    spark = texts.sparkSession
    run = Run(spark)
    none = F.lit(None).cast("string")

    def told(df):
        """Nodes (id, path, key, v) with value, or held where there is more below: told once, as the level is stored."""
        df = df.withColumn("_inner", F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        return df.select("id", "path", "key", "_inner", F.when(~F.col("_inner"), F.try_variant_get("v", "$", "string")).alias("value"), F.when(F.col("_inner"), F.col("v")).alias("held"))

    def deeper(level):
        below = level.where("_inner").select("id", F.col("path").alias("above"), F.col("key").alias("of"), "held").lateralJoin(spark.tvf.variant_explode(F.col("held").outer()))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        return told(below.select("id", F.concat("above", name).alias("path"), "key", F.col("value").alias("v")))

    more = (F.count_if("_inner").alias("more"),)
    root = texts.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), none.alias("key"), F.try_parse_json(json_col).alias("v")).where("v is not null")
    levels = [run.step("level-0", lambda: told(root), more)]
    while run.seen[f"level-{len(levels) - 1}"]["more"]:
        # A step that isn't stored would be walked again from the top by each later one.
        levels.append(run.step(f"level-{len(levels)}", lambda: deeper(levels[-1]), more))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("not _inner").select("id", "path", "key", "value")


def block_hashes(walked: DataFrame) -> DataFrame:
    """id, path, hash of every field that holds one, lower-cased."""
    return walked.where(F.col("key").isin(*BLOCK_HASH) & F.col("value").isNotNull()).select("id", "path", F.lower("value").alias("hash"))


def account_fields(walked: DataFrame) -> DataFrame:
    """id, path, account of every field that names an account by a whole address."""
    return walked.where(F.col("key").isin(*ACCOUNTS) & F.col("value").rlike(r"^0x[0-9a-fA-F]{40}\z")).select("id", "path", F.lower("value").alias("account"))

"""Versions of a physical fact: conflicts elect no winner, compatible versions complete each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stored

from .closure import components


def reconcile(versions: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """A row per key: versions, status (SINGLE, MERGED, CONFLICT), conflicts (field names), and each field's value where all
    known ones agree. Minimum and maximum tell that without gathering versions, so they are combined before the shuffle."""
    ends = [f(c).alias(f"{n}_{c}") for c in fields for n, f in (("lo", F.min), ("hi", F.max))]
    df = versions.groupBy(*key).agg(F.count("*").alias("versions"), *ends)
    clash = lambda c: F.coalesce(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(False))
    names = F.array_compact(F.array(*[F.when(clash(c), F.lit(c)) for c in fields]))
    df = df.withColumn("conflicts", names)
    status = F.when(F.size("conflicts") > 0, "CONFLICT").when(F.col("versions") > 1, "MERGED").otherwise("SINGLE")
    values = [F.when(~clash(c), F.col(f"lo_{c}")).alias(c) for c in fields]
    return df.select(*key, "versions", status.alias("status"), F.array_join("conflicts", ",").alias("conflicts"), *values)


def quarantined(versions: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The versions whose fact has a conflict."""
    bad = reconcile(versions, key, fields).where(F.col("status") == "CONFLICT").select(*key)
    return versions.join(bad, key, "left_semi")


def contradictions(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose rows differ in some field, with the number of different rows."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*fields)).alias("kinds")).where("kinds > 1")


def alias_groups(versions: DataFrame, event_id: str, physical: str) -> DataFrame:
    """versions with group, the smallest physical key of a fact: versions that share an id or a physical key, directly or by others, are of one fact.
    Only keys that an id with several of them joins are walked, each to its id's least; a version without a key has that of its id."""
    known = versions.where(F.col(event_id).isNotNull())
    least = known.groupBy(event_id).agg(F.min(physical).alias("_lo"), F.max(physical).alias("_hi"))
    met = known.where(F.col(physical).isNotNull()).select(event_id, physical).join(least.where("_lo <> _hi").select(event_id, "_lo"), event_id)
    roots = stored(components(met.select(F.col(physical).alias("a"), F.col("_lo").alias("b")), "aliases"), "alias-roots").withColumnRenamed("node", "_place")
    placed = known.where(F.col(physical).isNotNull()).withColumn("_place", F.col(physical))
    lacking = known.where(F.col(physical).isNull()).join(least.where("_lo is not null").select(event_id, F.col("_lo").alias("_place")), event_id)
    rows = placed.unionByName(lacking.select(placed.columns))
    return rows.join(roots, "_place", "left").withColumn("group", F.coalesce("root", "_place")).drop("_place", "root")


#: Ids that say where their fact is: chain, transaction, position.
BOUND_ID = "^(eip155:[0-9]+):tx:(0x[0-9a-f]{64}):(top|log:[0-9]+|trace:[0-9_]+)$"


def binding_conflict(event_id, chain, tx, position, asset) -> Column:
    """Does the id name another chain, transaction or position than its fact has, or the asset another chain?"""
    part = lambda i: F.regexp_extract(event_id, BOUND_ID, i)
    named = event_id.rlike(BOUND_ID) & ((part(1) != chain) | (part(2) != tx) | (part(3) != position))
    asset_chain = F.regexp_extract(asset, "^(?:native|erc20):(eip155:[0-9]+)", 1)
    return F.coalesce(named, F.lit(False)) | ((asset_chain != "") & (asset_chain != chain))


def manifest_faults(graph: DataFrame, manifest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and fault of every graph event that isn't as its manifest says: UNKNOWN_FACT, CONFLICTED_FACT, or the field that differs."""
    known = manifest.select(key, "conflicted", *[F.col(f).alias(f"m_{f}") for f in fields])
    df = graph.join(known, key, "left")
    fault = F.when(F.col("conflicted").isNull(), "UNKNOWN_FACT").when(F.col("conflicted"), "CONFLICTED_FACT")
    for f in fields:
        fault = fault.when(~F.col(f).eqNullSafe(F.col(f"m_{f}")), f)
    return df.withColumn("fault", fault).where("fault is not null").select(key, "fault")


def enrichment(old: DataFrame, new: DataFrame, key: str, fields: list[str], provenance: tuple[str, ...] = ()) -> DataFrame:
    """key, field, change between two versions of facts: PROVENANCE_CHANGE, COMPATIBLE_FILL (unknown before) or EXPLICIT_CHANGE, and ADDED or
    REMOVED facts."""
    a, b = (df.select(key, F.lit(True).alias(f"{p}_here"), *[F.col(f).alias(f"{p}_{f}") for f in fields]) for p, df in (("a", old), ("b", new)))
    change = lambda f: F.when(F.lit(f in provenance), "PROVENANCE_CHANGE").when(F.col(f"a_{f}").isNull(), "COMPATIBLE_FILL").otherwise("EXPLICIT_CHANGE")
    row = lambda f, c: F.struct(F.lit(f).alias("field"), c.alias("change"))
    both = [F.when(F.col("a_here") & F.col("b_here") & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), row(f, change(f))) for f in fields]
    ends = [F.when(F.col("b_here").isNull(), row("*", F.lit("REMOVED"))), F.when(F.col("a_here").isNull(), row("*", F.lit("ADDED")))]
    return a.join(b, key, "full").select(key, F.explode(F.array_compact(F.array(*ends, *both))).alias("x")).select(key, "x.*")


def revoked(returned: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Results (request_id, event_id) that were returned before, with state: a conflict (event_id) that came later revokes all of every result
    that holds one of its facts, so the evidence stays, as REVOKED. Only requests that a conflict touches are looked at as a whole."""
    touched = returned.join(conflicts.select("event_id").distinct(), "event_id", "left_semi").select("request_id").distinct().withColumn("_hit", F.lit(True))
    return returned.join(touched, "request_id", "left").withColumn("state", F.when(F.col("_hit"), "REVOKED").otherwise("VALID")).drop("_hit")

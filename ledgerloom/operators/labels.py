"""Identity of addresses out of label observations: the priority source wins, contradictions stay visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(addresses: DataFrame, observations: DataFrame) -> DataFrame:
    """address, rule, actor, role. A source's claims hold only if they name one actor and one role."""
    df = addresses.join(observations, "address", "left")
    first = F.col("platform") == "PRIORITY"
    other = F.col("platform") == "OTHER"
    pick = lambda c, on, f: f(F.when(on, F.col(c)))
    ends = [pick(c, on, f).alias(f"{n}_{k}_{c}") for c in ("actor", "role") for k, on in (("p", first), ("o", other)) for n, f in (("lo", F.min), ("hi", F.max))]
    df = df.groupBy("address").agg(*ends)
    clash = lambda k: (F.col(f"lo_{k}_actor") != F.col(f"hi_{k}_actor")) | (F.col(f"lo_{k}_role") != F.col(f"hi_{k}_role"))
    rule = (
        F.when(F.col("lo_p_actor").isNotNull(), F.when(clash("p"), "PRIORITY_CONFLICT").otherwise("PRIORITY"))
        .when(F.col("lo_o_actor").isNotNull(), F.when(clash("o"), "OTHER_CONFLICT").otherwise("OTHER"))
        .otherwise("BASELINE")
    )
    df = df.withColumn("rule", rule)
    value = lambda c: F.when(F.col("rule") == "PRIORITY", F.col(f"lo_p_{c}")).when(F.col("rule") == "OTHER", F.col(f"lo_o_{c}"))
    return df.select("address", "rule", value("actor").alias("actor"), F.coalesce(value("role"), F.lit("UNKNOWN")).alias("role"))


def opportunities(addresses: DataFrame, sources: list[str], matches: DataFrame) -> DataFrame:
    """One row per address and source: MATCH with the number of matches, or an explicit NO_MATCH."""
    asked = addresses.select("address", F.explode(F.array(*map(F.lit, sources))).alias("source"))
    counted = matches.groupBy("address", "source").agg(F.count("*").alias("matches"))
    out = asked.join(counted, ["address", "source"], "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return out.withColumn("outcome", F.when(F.col("matches") > 0, "MATCH").otherwise("NO_MATCH"))

"""Registered queries of identities: claims, resolution, lookups, queues and registries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import identity
from ledgerloom.sources.derived import read

#: Actors, labels and classes of the derived observations, by remainder.
ACTORS = ("OKEx", "okx", "Huobi Global", "HTX", "BitPay.com", "bitpay", "Sushi Swap", "Kraken", "")
ROLES = ("SERVICE", "BRIDGE_BOUNDARY", "SERVICE", "MIXER_BOUNDARY", "UNKNOWN")
NAMES = ("OKEx", "CEX Users", "Kraken", "user", "Hop Bridge", "Token Deployer", "Huobi", "")
TYPES = ("persona", "identifier", "usage", "identifier")
CATEGORIES = ("cex", "bridge", "dex", "other")
CONTRACTS = ("", "GnosisSafeProxy", "TokenBridge", "Tornado100", "SwapRouter", "Vault")
PRIMARIES = ("centralized exchange", "bridge", "", "privacy services", "decentralized exchange", "casino")
SOURCES = ("cex.addresses", "labels.addresses", "labels.owner_addresses", "cex.deposit_addresses")
RULES = ((1, "cex", "identifier", None, identity.CURATED), (2, "bridge", None, "api", identity.BRIDGE), (3, "cex", None, None, "GENERIC"))
OWNER_KEYS = ("binance", "gnosis_safe", "hop_protocol", "OpenSea", "", "Arbitrum")


def _one_of(values: tuple, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of their customers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    actor = _one_of(ACTORS, (c + F.when(k % 7 == 0, 1).otherwise(0)) % len(ACTORS))
    return read(spark, sf_dir, "orders").select(
        c.alias("address"),
        k.alias("observation_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Dune").when(F.col("o_orderpriority") == "2-HIGH", "Meta").otherwise("Etherscan").alias("platform"),
        actor.alias("actor"),
        _one_of(ROLES, (c + F.when(k % 11 == 0, 1).otherwise(0)) % len(ROLES)).alias("role"),
        F.when(k % 13 == 0, "A CEX user").when(k % 17 == 0, "Chainflip: Vault").otherwise(actor).alias("raw_label"),
        F.when(k % 23 == 0, "contract, Deployed by 0x1").alias("source_metadata"),
        F.when(k % 5 == 0, "BEHAVIOR").otherwise("ATTRIBUTION").alias("semantic_kind"),
        (k % 101 == 0).alias("record_conflict"),
        F.when(k % 19 == 0, "REFERENCE_TARGETED").otherwise("FRONTIER").alias("collection_scope"),
        F.when(k % 2 == 0, "RULE").alias("generation_mechanism"),
    )


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "SERVICE").when(F.col("c_mktsegment") == "MACHINERY", "CONFLICTED_IDENTITY").otherwise("UNKNOWN")
    return read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("address"), kind.alias("identity_class"), F.when(kind == "SERVICE", F.col("c_name")).otherwise("").alias("actor"))


def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve(observations(spark, sf_dir), baseline(spark, sf_dir))


def identity_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by platform, whether they claim an owner, and the actor they stand for."""
    o = observations(spark, sf_dir)
    name, key = identity.canonical_actor(F.col("actor"))
    claim = identity.explicit_claim(F.col("semantic_kind"), F.col("actor"), F.col("role"), F.concat_ws(" ", "raw_label", "source_metadata"))
    return o.groupBy("platform", claim.alias("claim"), name.alias("actor"), key.alias("actor_key")).agg(F.count("*").alias("n"))


def identity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resolved identities are for a trace, under either policy for conflicts, and the state of their lookup; customers that no one
    resolved are asked too."""
    found = identity_resolve(spark, sf_dir).select("address", "identity_class")
    k = F.col("address")
    status = F.when(k % 23 == 0, "UNQUERIED").when(k % 29 == 0, "LOOKUP_FAILED_HTTP").when(k % 31 == 0, "BUDGET_BLOCKED").otherwise("SUCCESS")
    asked = read(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("address")).join(found.withColumn("status", status), "address", "left")
    c, s = F.col("identity_class"), F.col("status")
    columns = [identity.identity_kind(c).alias("kind"), identity.identity_kind(c, "boundary").alias("boundary_kind"), identity.lookup_state(c, s).alias("lookup"), identity.lookup_state(c, s, "BUDGET_BLOCKED").alias("cached_lookup")]
    return asked.groupBy(*columns).agg(F.count("*").alias("n"), F.sum("address").alias("ids"))


def lookup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for each customer: orders as the records that came back for it."""
    records = read(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").groupBy(F.col("o_custkey").alias("address")).agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("s"))
    k = F.col("address")
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address")).join(records, "address", "left")
    code = F.when(k % 7 == 0, 500).when(k % 11 != 0, 200000)
    outcome = identity.lookup_outcome(code, F.coalesce("n", F.lit(0)), F.when(F.col("s") == "F", "entity"), F.when(F.col("s") == "O", "tag"))
    return df.select("address", outcome.alias("outcome"))


def label_lookup_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four label sources for a frontier (customers whose id 37 divides), counted and listed as JSON."""
    frontier = read(spark, sf_dir, "customer").where("c_custkey % 37 = 0").select(F.col("c_custkey").alias("address"))
    o = read(spark, sf_dir, "orders")
    payload = F.map_from_arrays(F.array(F.lit("name"), F.lit("type")), F.array(F.col("o_orderpriority"), F.col("o_orderstatus")))
    sources = {f"s{i}": o.where(F.col("o_orderkey") % 4 == i).select(F.col("o_custkey").alias("address"), payload.alias("payload")) for i in range(4)}
    return identity.looked_up(frontier, sources)


def label_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labels of four sources, with owners that agree or don't, personas, behaviour and generic names."""
    k = F.col("o_orderkey")
    source, name, after = _one_of(SOURCES, k % 4), _one_of(NAMES, F.floor(k / 4) % 8), _one_of(NAMES, (F.floor(k / 4) + 1) % 8)
    owned = source == "labels.owner_addresses"
    rows = read(spark, sf_dir, "orders").select(
        k.alias("row_id"), source.alias("source"), F.when(source.startswith("cex"), name).alias("cex_name"), F.when(source == "labels.addresses", name).alias("name"), _one_of(TYPES, F.floor(k / 8) % 4).alias("label_type"),
        _one_of(CATEGORIES, F.floor(k / 3) % 4).alias("category"), F.when(k % 6 == 0, "query").otherwise("api").alias("record_source"), F.when(owned, _one_of(OWNER_KEYS, F.floor(k / 9) % 6)).alias("owner_key"),
        F.when(owned & (k % 3 != 1), name).alias("custody_owner"), F.when(owned & (k % 3 == 0), after).alias("account_owner"), F.when(k % 5 == 0, name).alias("detail_name"), _one_of(PRIMARIES, F.floor(k / 7) % 6).alias("primary"),
        F.when(k % 11 == 0, "defi, Mixer").alias("tags"), _one_of(CONTRACTS, F.floor(k / 5) % 6).alias("contract"), F.when(k % 29 == 0, "User of it").alias("distinct_name"), F.when(k % 10 == 0, "a1").alias("algorithm"),
    )
    rules = spark.createDataFrame(RULES, "ordinal int, category string, label_type string, record_source string, class string")
    found = identity.classified(rows, rules)
    return found.groupBy("source", "role", "semantic_kind", "actor", "actor_key", "record_conflict", "generation_mechanism", "rule").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


def label_failed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer").where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("address"))
    opportunities, registry = identity.failed_lookups(asked, ["F", "O", "P", "X"], "TIMEOUT")
    return opportunities.join(registry, "address").select("address", "source", "outcome", "reason", "identity_class", "lookup_status")


def label_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an unknown address of the candidate pool may or may not be asked again; the first reason counts."""
    pool = _pool(spark, sf_dir)
    known = read(spark, sf_dir, "orders").where("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("address")).distinct().withColumn("asked", F.lit(True))
    registry = identity_resolve(spark, sf_dir).select("address", "identity_class")
    df = pool.join(known, "address", "left").join(registry, "address", "left")
    reason = (
        F.when(F.col("asked"), "PREVIOUS_SUCCESS_INCLUDING_EMPTY")
        .when(F.col("identity_class").isin("SERVICE", "BRIDGE_BOUNDARY", "MIXER_BOUNDARY"), "ALREADY_RESOLVED")
        .when(F.col("identity_class") == "CONFLICTED_IDENTITY", "CONFLICT_PRESERVED")
        .when(F.col("pairs") == 0, "NO_CURRENT_POLICY_STRUCTURE_WITNESS")
        .otherwise("ELIGIBLE")
    )
    return df.select("address", reason.alias("reason"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate addresses: the part keys of their customers' orders as queries, the order's priority as incident."""
    o = read(spark, sf_dir, "orders")
    some = F.col("o_orderkey") % 3 == 0
    return o.groupBy(F.col("o_custkey").alias("address")).agg(F.count_distinct(F.when(some, F.col("o_orderkey"))).alias("pairs"), F.min("o_orderpriority").alias("incident"), F.when(F.count_if(F.col("o_orderkey") % 50 == 0) > 0, 0).when(F.count_if(F.col("o_orderkey") % 7 == 0) > 0, 1).otherwise(2).alias("tier"))


def label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir)


def label_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten addresses to look up next."""
    return identity.queue(_pool(spark, sf_dir).where("pairs > 0"))


def registry_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows that a set of addresses needs, and the addresses that it lacks."""
    full = identity_resolve(spark, sf_dir).select("address", "identity_class")
    needed = read(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select((F.col("o_custkey") * 2).alias("address")).distinct()
    have = full.join(needed, "address", "left_semi")
    return have.union(needed.join(full, "address", "left_anti").select("address", F.lit("MISSING").alias("identity_class")))


def registry_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a registry changes as later observations (odd ids) come to earlier ones: counts by class before and after."""
    o, b = observations(spark, sf_dir), baseline(spark, sf_dir)
    before = identity.resolve(o.where("observation_id % 2 = 0"), b).select("address", F.col("identity_class").alias("was"))
    after = identity.resolve(o, b).select("address", F.col("identity_class").alias("is"))
    both = before.join(after, "address", "full")
    return both.groupBy(F.coalesce("was", F.lit("ABSENT")).alias("was"), F.coalesce("is", F.lit("ABSENT")).alias("is")).agg(F.count("*").alias("n"), F.count_if(~F.col("was").eqNullSafe(F.col("is"))).alias("changed"))


def queries() -> dict:
    found = (
        identity_resolve, identity_claims, identity_kinds, lookup_outcomes, label_lookup_agg, label_classify, label_failed_lookup, label_eligibility, label_pool,
        label_queue, registry_slice, registry_deltas,
    )
    return {f.__name__: f for f in found}


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_OBS = f"""ob AS (SELECT o_custkey AS address, o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'Dune' WHEN '2-HIGH' THEN 'Meta' ELSE 'Etherscan' END AS platform,
  {_list(ACTORS)}[(o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % {len(ACTORS)} + 1] AS actor, {_list(ROLES)}[(o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % {len(ROLES)} + 1] AS role,
  o_orderkey % 13 = 0 OR o_orderkey % 23 = 0 AS behaves, o_orderkey % 13 <> 0 AND o_orderkey % 17 = 0 AS vault, o_orderkey % 5 <> 0 AS attributes, o_orderkey % 101 = 0 AS bad, o_orderkey % 19 = 0 AS targeted, o_orderkey % 2 <> 0 AS undisclosed FROM orders),
cl AS (SELECT *, attributes AND actor <> '' AND NOT behaves AND role <> 'UNKNOWN' AS claim, platform = 'Dune' AS dune, CASE actor WHEN 'BitPay.com' THEN 'bitpay' ELSE lower(regexp_replace(actor, '[^A-Za-z0-9]', '', 'g')) END AS key FROM ob),
bl AS (SELECT c_custkey AS address, CASE c_mktsegment WHEN 'BUILDING' THEN 'SERVICE' WHEN 'MACHINERY' THEN 'CONFLICTED_IDENTITY' ELSE 'UNKNOWN' END AS base, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS base_actor FROM customer WHERE c_custkey % 3 <> 0)"""


def _resolved(rows: str, out: str) -> str:
    """The ladder of rules over counts of distinct keys and roles."""
    return f"""{out}_g AS (SELECT address, bool_or(dune AND claim) AS hd, bool_or(claim) AS hc, bool_or(dune AND vault) AND bool_or(dune AND key = 'sushiswap') AS raw, bool_or(targeted) AS targeted, count(*) AS n, count(*) FILTER (WHERE undisclosed) AS undisclosed,
  count(DISTINCT key) FILTER (WHERE claim AND dune) AS kd, count(DISTINCT key) FILTER (WHERE claim) AS kc, count(DISTINCT role) FILTER (WHERE claim AND dune) AS rd, count(DISTINCT role) FILTER (WHERE claim) AS rc, coalesce(bool_or(bad AND claim AND dune), false) AS bd,
  coalesce(bool_or(bad AND claim), false) AS bc, arg_min(actor, k) FILTER (WHERE claim AND dune) AS ad, arg_min(actor, k) FILTER (WHERE claim) AS ac, min(role) FILTER (WHERE claim AND dune) AS md, min(role) FILTER (WHERE claim) AS mc, min(key) FILTER (WHERE claim AND dune) AS yd, min(key) FILTER (WHERE claim) AS yc FROM {rows} GROUP BY address),
{out}_h AS (SELECT coalesce(g.address, bl.address) AS address, coalesce(hd, false) AS hd, coalesce(hc, false) AS hc, coalesce(raw, false) AS raw, coalesce(targeted, false) AS targeted, coalesce(n, 0) AS n, coalesce(undisclosed, 0) AS undisclosed, base IS NOT NULL AS based, coalesce(base, 'UNKNOWN') AS base, base_actor,
  coalesce(kc, 0) > 1 AS several, CASE WHEN hd THEN kd > 1 OR rd > 1 OR bd ELSE coalesce(kc > 1 OR rc > 1 OR bc, false) END OR coalesce(raw, false) AS conflict, CASE WHEN hd THEN ad ELSE ac END AS a, CASE WHEN hd THEN md ELSE mc END AS r, CASE WHEN hd THEN yd ELSE yc END AS y FROM {out}_g g FULL JOIN bl ON bl.address = g.address),
{out}_i AS (SELECT *, CASE WHEN NOT hd AND NOT raw AND based AND NOT targeted THEN 'EXISTING_OTHER_SOURCE_RESOLUTION_RETAINED' WHEN hc AND NOT conflict THEN CASE WHEN hd THEN 'DUNE_EXPLICIT_INTERNALLY_CONSISTENT_PRIORITY' ELSE 'APPROVED_PROFESSIONAL_SOURCE_FALLBACK' END
  WHEN hc OR raw THEN CASE WHEN hd OR raw THEN 'DUNE_INTERNAL_CONFLICT_PRESERVED' ELSE 'OTHER_SOURCE_CONFLICT_PRESERVED' END ELSE 'EXISTING_ROLE_RETAINED_NO_NEW_EXPLICIT_OWNERSHIP' END AS rule FROM {out}_h),
{out} AS (SELECT address, CASE WHEN rule LIKE '%PRIORITY' OR rule LIKE 'APPROVED%' THEN r WHEN rule LIKE '%CONFLICT_PRESERVED' THEN 'CONFLICTED_IDENTITY' ELSE base END AS identity_class, CASE WHEN rule LIKE '%PRIORITY' OR rule LIKE 'APPROVED%' THEN CASE WHEN y = 'bitpay' THEN 'BitPay' ELSE a END WHEN rule LIKE 'EXISTING%' THEN base_actor END AS actor, rule,
  CASE WHEN raw OR (hd AND conflict) THEN 'DUNE_INTERNAL_CONFLICT' WHEN several THEN 'RAW_CROSS_SOURCE_CONFLICT_RETAINED' ELSE 'NO_EXPLICIT_CONFLICT' END AS conflict_status, conflict OR several OR base = 'CONFLICTED_IDENTITY' AS preserved_conflict, n AS observations, undisclosed FROM {out}_i)"""


def oracle_sql() -> dict[str, str]:
    whole = f"WITH {_OBS}, {_resolved('cl', 'res')}"
    kind = lambda p: f"CASE identity_class WHEN 'SERVICE' THEN 'SERVICE' WHEN 'BRIDGE_BOUNDARY' THEN 'BRIDGE' WHEN 'MIXER_BOUNDARY' THEN 'MIXER' {p} ELSE 'UNKNOWN' END"
    state = lambda m: f"CASE WHEN identity_class IS NULL THEN '{m}' WHEN a % 23 = 0 THEN 'UNQUERIED' WHEN a % 29 = 0 THEN 'LOOKUP_FAILED' WHEN a % 31 = 0 THEN 'BUDGET_BLOCKED' WHEN identity_class = 'CONFLICTED_IDENTITY' THEN 'LABEL_CONFLICT' ELSE 'FROZEN_LOCAL_OBSERVATION' END"
    canon = "CASE actor WHEN 'OKEx' THEN 'OKX' WHEN 'okx' THEN 'OKX' WHEN 'Huobi Global' THEN 'HTX' ELSE actor END"
    pool = """pl AS (SELECT o_custkey AS address, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS pairs, min(o_orderpriority) AS incident, CASE WHEN bool_or(o_orderkey % 50 = 0) THEN 0 WHEN bool_or(o_orderkey % 7 = 0) THEN 1 ELSE 2 END AS tier FROM orders GROUP BY o_custkey)"""
    lists = ", ".join(f"CAST(coalesce(c{i}, 0) AS BIGINT) AS s{i}_count, '[' || coalesce(j{i}, '') || ']' AS s{i}_json" for i in range(4))
    joins = " ".join(f"LEFT JOIN (SELECT o_custkey AS a{i}, count(*) AS c{i}, string_agg(j, ',' ORDER BY j) AS j{i} FROM jo WHERE o_orderkey % 4 = {i} GROUP BY o_custkey) ON a{i} = c_custkey" for i in range(4))
    return {
        "identity_resolve": f"{whole} SELECT *, CASE WHEN identity_class = 'SERVICE' THEN 'NAMED_SERVICE_IDENTITY_USABLE' ELSE 'NOT_CONFIRMED_AS_REQUESTABLE_SERVICE' END AS service_status FROM res",
        "identity_claims": f"WITH {_OBS} SELECT platform, claim, {canon} AS actor, CASE {canon} WHEN 'OKX' THEN 'okx' WHEN 'HTX' THEN 'htx' ELSE lower(regexp_replace(actor, '[^A-Za-z0-9]', '', 'g')) END AS actor_key, count(*) AS n FROM cl GROUP BY ALL",
        "identity_kinds": f"""{whole}, q AS (SELECT c_custkey * 2 AS a, identity_class FROM customer LEFT JOIN res ON address = c_custkey * 2)
SELECT {kind("")} AS kind, {kind("WHEN 'CONFLICTED_IDENTITY' THEN 'UNSUPPORTED_PROTOCOL'")} AS boundary_kind, {state("UNQUERIED")} AS lookup, {state("BUDGET_BLOCKED")} AS cached_lookup, count(*) AS n, CAST(sum(a) AS BIGINT) AS ids FROM q GROUP BY ALL""",
        "lookup_outcomes": """WITH r AS (SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS s FROM orders WHERE o_orderkey % 4 = 0 GROUP BY o_custkey)
SELECT c_custkey AS address, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'FAILED_OR_UNRESOLVED' WHEN coalesce(n, 0) <> 1 THEN 'MISSING_OR_DUPLICATE_ADDRESS_UNRESOLVED' WHEN s = 'F' THEN 'NAMED_ENTITY_RETURNED' WHEN s = 'O' THEN 'OTHER_LABEL_RETURNED' ELSE 'EMPTY_LABEL_RESULT' END AS outcome FROM customer LEFT JOIN r ON o_custkey = c_custkey""",
        "label_lookup_agg": f"""WITH jo AS (SELECT o_custkey, o_orderkey, '{{"name":"' || o_orderpriority || '","type":"' || o_orderstatus || '"}}' AS j FROM orders) SELECT c_custkey AS address, {lists} FROM customer {joins} WHERE c_custkey % 37 = 0""",
        "label_classify": f"""WITH nm(name, can, key) AS (VALUES ('OKEx', 'OKX', 'okx'), ('CEX Users', 'CEX Users', 'cexusers'), ('Kraken', 'Kraken', 'kraken'), ('user', 'user', 'user'), ('Hop Bridge', 'Hop Bridge', 'hopbridge'), ('Token Deployer', 'Token Deployer', 'tokendeployer'), ('Huobi', 'HTX', 'htx')),
x AS (SELECT o_orderkey AS k, {_list(SOURCES)}[o_orderkey % 4 + 1] AS source, {_list(NAMES)}[o_orderkey // 4 % 8 + 1] AS name, {_list(NAMES)}[(o_orderkey // 4 + 1) % 8 + 1] AS after, {_list(TYPES)}[o_orderkey // 8 % 4 + 1] AS type, {_list(CATEGORIES)}[o_orderkey // 3 % 4 + 1] AS category,
  lower({_list(CONTRACTS)}[o_orderkey // 5 % 6 + 1]) AS contract, {_list(PRIMARIES)}[o_orderkey // 7 % 6 + 1] AS prim, {_list(OWNER_KEYS)}[o_orderkey // 9 % 6 + 1] AS owner FROM orders),
o AS (SELECT x.*, list_sort(list_distinct(list_filter([CASE WHEN k % 3 <> 1 THEN {{'k': a.key, 'n': a.can}} END, CASE WHEN k % 3 = 0 THEN {{'k': b.key, 'n': b.can}} END, CASE WHEN k % 5 = 0 THEN {{'k': a.key, 'n': a.can}} END], lambda z: z.k IS NOT NULL))) AS owners, a.can, a.key
  FROM x LEFT JOIN nm a ON a.name = x.name LEFT JOIN nm b ON b.name = x.after),
m AS (SELECT *, source = 'labels.owner_addresses' AS owned, source LIKE 'cex%' AS cex, source = 'labels.addresses' AND type IN ('persona', 'usage') AS persona, CASE WHEN category = 'cex' THEN CASE WHEN type = 'identifier' THEN 'CURATED_NAMED_CUSTODIAL_IF_NON_GENERIC_ACTOR' ELSE 'GENERIC' END WHEN category = 'bridge' AND k % 6 <> 0 THEN 'NAMED_BRIDGE' ELSE 'UNMAPPED' END AS mapped FROM o),
g AS (SELECT *, NOT owned AND NOT cex AND NOT persona AND mapped IN ('CURATED_NAMED_CUSTODIAL_IF_NON_GENERIC_ACTOR', 'NAMED_BRIDGE') AS named FROM m),
h AS (SELECT *, CASE WHEN owned THEN CASE WHEN len(owners) > 0 THEN array_to_string(list_transform(owners, lambda z: z.n), ' | ') ELSE owner END WHEN cex OR named THEN coalesce(can, '') ELSE '' END AS act,
  CASE WHEN owned THEN CASE WHEN len(owners) > 0 THEN array_to_string(list_transform(owners, lambda z: z.k), '') ELSE replace(lower(owner), '_', '') END WHEN cex OR named THEN coalesce(key, '') ELSE '' END AS akey, coalesce(NOT owned AND NOT cex AND name IN ('CEX Users', 'Token Deployer'), false) OR k % 29 = 0 AS behaves FROM g),
w AS (SELECT *, CASE WHEN cex THEN 0 WHEN named THEN CASE mapped WHEN 'NAMED_BRIDGE' THEN 7 ELSE 6 END WHEN NOT owned THEN 8 WHEN owner = 'gnosis_safe' OR contract LIKE 'gnosissafe%' THEN 1 WHEN prim = 'bridge' OR contract LIKE '%bridge%' OR owner IN ('hop_protocol', 'Arbitrum') THEN 2
  WHEN prim = 'privacy services' OR contract LIKE '%tornado%' OR k % 11 = 0 THEN 3 WHEN prim = 'decentralized exchange' OR owner = 'OpenSea' OR contract LIKE '%router%' THEN 4 WHEN prim IN ('centralized exchange', 'casino') THEN 5 ELSE 9 END AS w, akey IN ('', 'user') AS nameless FROM h),
r AS (SELECT *, ['SERVICE', 'DEX_OR_PROTOCOL', 'BRIDGE_BOUNDARY', 'MIXER_BOUNDARY', 'DEX_OR_PROTOCOL', 'SERVICE', 'SERVICE', 'BRIDGE_BOUNDARY', 'UNKNOWN', 'UNKNOWN'][w + 1] AS role0,
  CASE WHEN source = 'cex.addresses' THEN 'EXPLICIT_CEX_NAMED_ADDRESS' WHEN cex THEN 'PROGRAMMATIC_NAMED_DEPOSIT_NOT_MANUAL_OR_LEGAL_CONFIRMATION' WHEN persona THEN 'PERSONA_OR_USAGE_NEVER_CONTROL_ATTRIBUTION' WHEN NOT owned THEN 'INHERITED_LABELS_ADDRESSES_V2:' || mapped ELSE ['OWNER_GNOSIS_SAFE_SELF_CUSTODY_PROTOCOL_GUARD', 'OWNER_PRIMARY_OR_CONTRACT_BRIDGE_BOUNDARY',
  'OWNER_PRIVACY_OR_MIXER_BOUNDARY', 'OWNER_DEX_PROTOCOL_OR_OPENSEA_BOUNDARY', 'OWNER_DETAILS_PRIMARY_CATEGORY_CUSTODIAL_ALLOWLIST', '', '', '', 'OWNER_METADATA_INSUFFICIENT_FOR_SERVICE_OR_PROTOCOL_ROLE'][w] END AS why FROM w)
SELECT source, CASE WHEN nameless OR behaves THEN 'UNKNOWN' ELSE role0 END AS role, CASE WHEN behaves OR persona THEN 'BEHAVIOR' WHEN w < 8 AND NOT nameless THEN 'ATTRIBUTION' ELSE 'CONTEXT' END AS semantic_kind, CASE WHEN NOT nameless AND NOT behaves THEN act END AS actor, CASE WHEN NOT nameless AND NOT behaves THEN akey END AS actor_key,
  owned AND len(owners) > 1 AS record_conflict, CASE WHEN source = 'cex.deposit_addresses' OR k % 10 = 0 OR k % 6 = 0 THEN 'ALGORITHM_IDENTIFIED' END AS generation_mechanism, why || CASE WHEN nameless THEN ';NAMED_ACTOR_REQUIRED' ELSE '' END || CASE WHEN behaves THEN ';BEHAVIOR_OR_DEPLOYER_NOT_CONTROL' ELSE '' END AS rule, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM r GROUP BY ALL""",
        "label_failed_lookup": "SELECT c_custkey AS address, source, 'FAILED' AS outcome, 'TIMEOUT' AS reason, 'UNKNOWN' AS identity_class, 'LOOKUP_FAILED_TIMEOUT' AS lookup_status FROM customer, (VALUES ('F'), ('O'), ('P'), ('X')) s(source) WHERE c_custkey % 11 = 0",
        "label_eligibility": f"""{whole}, {pool} SELECT pl.address, CASE WHEN pl.address IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0) THEN 'PREVIOUS_SUCCESS_INCLUDING_EMPTY' WHEN identity_class IN ('SERVICE', 'BRIDGE_BOUNDARY', 'MIXER_BOUNDARY') THEN 'ALREADY_RESOLVED'
  WHEN identity_class = 'CONFLICTED_IDENTITY' THEN 'CONFLICT_PRESERVED' WHEN pairs = 0 THEN 'NO_CURRENT_POLICY_STRUCTURE_WITNESS' ELSE 'ELIGIBLE' END AS reason FROM pl LEFT JOIN res USING (address)""",
        "label_pool": f"WITH {pool} SELECT * FROM pl",
        "label_queue": f"""WITH {pool}, t AS (SELECT *, row_number() OVER (PARTITION BY tier, pairs, incident ORDER BY address) AS turn FROM pl WHERE pairs > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY tier, pairs DESC, turn, address) > 3 AS relaxed FROM t), u AS (SELECT * EXCLUDE (turn), row_number() OVER (PARTITION BY relaxed, tier, pairs, incident ORDER BY address) AS turn FROM n)
SELECT row_number() OVER (ORDER BY relaxed, tier, pairs DESC, turn, incident, address) AS rank, address, tier, pairs, incident, relaxed FROM u QUALIFY rank <= 10""",
        "registry_slice": f"{whole}, nd AS (SELECT DISTINCT o_custkey * 2 AS address FROM orders WHERE o_orderkey % 20 = 0) SELECT address, coalesce(identity_class, 'MISSING') AS identity_class FROM nd LEFT JOIN res USING (address)",
        "registry_deltas": f"""{whole}, ev AS (SELECT * FROM cl WHERE k % 2 = 0), {_resolved("ev", "pre")}
SELECT coalesce(p.identity_class, 'ABSENT') AS was, coalesce(r.identity_class, 'ABSENT') AS "is", count(*) AS n, count(*) FILTER (WHERE p.identity_class IS DISTINCT FROM r.identity_class) AS changed FROM pre p FULL JOIN res r USING (address) GROUP BY ALL""",
    }

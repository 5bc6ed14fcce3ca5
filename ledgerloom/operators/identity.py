"""Identity of accounts: claims out of observations, their resolution, lookups and what they mean for a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class of an identity, and the kind of account it is for a trace.
KINDS = {"SERVICE": "SERVICE", "BRIDGE_BOUNDARY": "BRIDGE", "MIXER_BOUNDARY": "MIXER", "DEX_OR_PROTOCOL": "UNSUPPORTED_PROTOCOL"}
# Lookups that did not end in an answer, in order of precedence.
UNANSWERED = ("UNQUERIED", "LOOKUP_FAILED", "BUDGET_BLOCKED")
# Spellings of actors and the name and key they stand for.
ALIASES = {"okex": ("OKX", "okx"), "okx": ("OKX", "okx"), "huobi": ("HTX", "htx"), "huobiglobal": ("HTX", "htx"), "htx": ("HTX", "htx"), "coinbaseexchange": ("Coinbase", "coinbase")}
# Behaviour that names no owner, roles a claim may have, accounts nobody owns, names that name nobody.
BEHAVIOUR = r"\b(cex users?|dex users?|exchange users?|deployer|deployed by)\b|user of"
ROLES = ("SERVICE", "BRIDGE_BOUNDARY", "MIXER_BOUNDARY", "DEX_OR_PROTOCOL")
SENTINELS = ("0x" + "0" * 40, "0x" + "0" * 36 + "dead")
GENERIC = ("unknown", "exchange", "cex", "dex", "institution", "bridge", "service", "user", "users", "wallet")


def actor_key(actor: Column) -> Column:
    """Lower-case letters and digits of a name."""
    return F.regexp_replace(F.lower(F.coalesce(actor, F.lit(""))), "[^a-z0-9]", "")


def canonical_actor(actor: Column) -> tuple[Column, Column]:
    """Name and key that a spelling stands for."""
    own = actor_key(actor)
    names, keys = (F.create_map(*[F.lit(x) for k, v in ALIASES.items() for x in (k, v[i])]) for i in (0, 1))
    return F.coalesce(F.try_element_at(names, own), F.trim(F.coalesce(actor, F.lit("")))), F.coalesce(F.try_element_at(keys, own), own)


def identity_kind(identity_class: Column, conflict_policy: str = "continue") -> Column:
    """Kind of account of an identity class. A conflicted identity goes on as unknown, or is a boundary ("boundary")."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), identity_class), F.lit("UNKNOWN"))
    return F.when(identity_class == "CONFLICTED_IDENTITY", "UNSUPPORTED_PROTOCOL").otherwise(kind) if conflict_policy == "boundary" else kind


def lookup_state(identity_class: Column, lookup_status: Column, missing: str = "UNQUERIED") -> Column:
    """What is known of an account's lookup: the unanswered states by name or prefix, a conflict of labels, else a frozen observation."""
    out = F.when(identity_class.isNull(), missing)
    for s in UNANSWERED:
        out = out.when((lookup_status == s) | lookup_status.startswith(f"{s}_"), s)
    return out.when(identity_class == "CONFLICTED_IDENTITY", "LABEL_CONFLICT").otherwise("FROZEN_LOCAL_OBSERVATION")


def lookup_outcome(code: Column, n_matches: Column, entity: Column, other: Column) -> Column:
    """What a lookup says of its address: a failed one never says that there is no label."""
    return (
        F.when(~F.coalesce(code == 200000, F.lit(False)), "FAILED_OR_UNRESOLVED")
        .when(n_matches != 1, "MISSING_OR_DUPLICATE_ADDRESS_UNRESOLVED")
        .when(F.coalesce(entity, F.lit("")) != "", "NAMED_ENTITY_RETURNED")
        .when(F.coalesce(other, F.lit("")) != "", "OTHER_LABEL_RETURNED")
        .otherwise("EMPTY_LABEL_RESULT")
    )


def explicit_claim(semantic_kind: Column, actor: Column, role: Column, text: Column) -> Column:
    """Does an observation say who owns the address? A deployer, behaviour or persona doesn't."""
    return (semantic_kind == "ATTRIBUTION") & (F.coalesce(actor, F.lit("")) != "") & ~F.lower(F.coalesce(text, F.lit(""))).rlike(BEHAVIOUR) & role.isin(*ROLES)


def resolve(observations: DataFrame, baseline: DataFrame) -> DataFrame:
    """A row per address of observations or baseline: identity_class, actor, rule, conflict, and counts. Claims of the platform Dune go before
    all others; if those that count name several actors or roles, or a record is in conflict with itself, no one is adopted.

    observations: address, observation_id, platform, actor, role, raw_label, semantic_kind, record_conflict, collection_scope,
    generation_mechanism, perhaps source_metadata. baseline: address, identity_class, actor. Sets of actors and roles are told by their ends, so they combine
    before the shuffle."""
    c = F.col
    text = F.concat_ws(" ", "raw_label", *(["source_metadata"] if "source_metadata" in observations.columns else []))
    claim = explicit_claim(c("semantic_kind"), c("actor"), c("role"), text)
    own = actor_key(c("actor"))
    df = observations.withColumns({"claim": claim, "key": F.when(own == "bitpaycom", "bitpay").otherwise(own), "first": c("platform") == "Dune"})
    by_dune, by_any = claim_on(c("first") & c("claim")), claim_on(c("claim"))
    ends = {f"{f.__name__}_{k}_{p}": f(on(c(k))) for k in ("key", "role") for p, on in (("d", by_dune), ("a", by_any)) for f in (F.min, F.max)}
    sums = df.groupBy("address").agg(
        *[v.alias(k) for k, v in ends.items()],
        F.min_by("actor", F.when(c("first") & c("claim"), c("observation_id"))).alias("actor_d"),
        F.min_by("actor", F.when(c("claim"), c("observation_id"))).alias("actor_a"),
        F.count_if(c("first") & c("claim")).alias("n_d"),
        F.count_if("claim").alias("n_claims"),
        F.count_if(c("first") & c("claim") & c("record_conflict")).alias("bad_d"),
        F.count_if(c("claim") & c("record_conflict")).alias("bad_a"),
        (F.count_if(c("first") & c("raw_label").contains("Chainflip: Vault")) > 0).alias("vault"),
        (F.count_if(c("first") & (own == "sushiswap")) > 0).alias("swap"),
        F.count_if(c("collection_scope") == "REFERENCE_TARGETED").alias("targeted"),
        F.count_if(F.coalesce(c("generation_mechanism"), F.lit("")) == "").alias("undisclosed"),
        F.count("*").alias("observations"),
    )
    b = baseline.select("address", c("identity_class").alias("base_class"), F.when(c("actor") != "", c("actor")).alias("base_actor"), F.lit(True).alias("based"))
    df = sums.join(b, "address", "full")
    zero = lambda n: F.coalesce(c(n), F.lit(0).cast("long"))
    dune, raw = zero("n_d") > 0, F.coalesce(c("vault") & c("swap"), F.lit(False))
    pick = lambda d, a: F.when(dune, c(d)).otherwise(c(a))
    differ = lambda k: F.coalesce(pick(f"min_{k}_d", f"min_{k}_a") != pick(f"max_{k}_d", f"max_{k}_a"), F.lit(False))
    conflict = differ("key") | differ("role") | (F.coalesce(pick("bad_d", "bad_a"), F.lit(0)) > 0) | raw
    picked = zero("n_claims") > 0
    kept = ~dune & ~raw & F.coalesce(c("based"), F.lit(False)) & (zero("targeted") == 0)
    base = F.coalesce(c("base_class"), F.lit("UNKNOWN"))
    name = pick("actor_d", "actor_a")
    name = F.when(pick("min_key_d", "min_key_a") == "bitpay", "BitPay").otherwise(name)
    sentinel = c("address").cast("string").isin(*SENTINELS)
    rule = (
        F.when(sentinel, "NON_SERVICE_SENTINEL")
        .when(kept, "EXISTING_OTHER_SOURCE_RESOLUTION_RETAINED")
        .when(picked & ~conflict, F.when(dune, "DUNE_EXPLICIT_INTERNALLY_CONSISTENT_PRIORITY").otherwise("APPROVED_PROFESSIONAL_SOURCE_FALLBACK"))
        .when(picked | raw, F.when(dune | raw, "DUNE_INTERNAL_CONFLICT_PRESERVED").otherwise("OTHER_SOURCE_CONFLICT_PRESERVED"))
        .otherwise("EXISTING_ROLE_RETAINED_NO_NEW_EXPLICIT_OWNERSHIP")
    )
    df = df.withColumns({"rule": rule, "conflict": conflict, "adopted": picked & ~conflict & ~kept & ~sentinel, "clash": (picked | raw) & conflict & ~kept & ~sentinel, "several": F.coalesce(c("min_key_a") != c("max_key_a"), F.lit(False))})
    role = F.when(sentinel, "NON_SERVICE_SENTINEL").when(F.col("adopted"), pick("min_role_d", "min_role_a")).when(F.col("clash"), "CONFLICTED_IDENTITY").otherwise(base)
    status = F.when(raw | (dune & c("conflict")), "DUNE_INTERNAL_CONFLICT").when(F.col("several"), "RAW_CROSS_SOURCE_CONFLICT_RETAINED").otherwise("NO_EXPLICIT_CONFLICT")
    return df.select(
        "address",
        role.alias("identity_class"),
        F.when(F.col("adopted"), name).when(~c("clash"), c("base_actor")).alias("actor"),
        "rule",
        status.alias("conflict_status"),
        (c("conflict") | c("several") | (base == "CONFLICTED_IDENTITY")).alias("preserved_conflict"),
        zero("observations").alias("observations"),
        zero("undisclosed").alias("undisclosed"),
        F.when(role == "SERVICE", "NAMED_SERVICE_IDENTITY_USABLE").otherwise("NOT_CONFIRMED_AS_REQUESTABLE_SERVICE").alias("service_status"),
    )


def claim_on(on: Column):
    return lambda col: F.when(on, col)


def looked_up(frontier: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """For each address of a frontier, the number of rows and the rows as a JSON list (sorted, doubles kept) that each source has; no row is a
    count of zero and an empty list. sources: name -> (address, payload as map)."""
    out = frontier.select("address").distinct()
    for name, rows in sources.items():
        asked = rows.join(frontier.select("address").distinct(), "address", "left_semi")
        # A frontier is short, and an address has few rows of a source.
        lists = asked.groupBy("address").agg(F.count("*").alias(f"{name}_count"), F.array_join(F.array_sort(F.collect_list(F.to_json("payload"))), ",").alias("j"))
        out = out.join(lists.select("address", f"{name}_count", F.concat(F.lit("["), "j", F.lit("]")).alias(f"{name}_json")), "address", "left")
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) if c.endswith("_count") else F.coalesce(c, F.lit("[]")) for c in out.columns if c != "address"}
    return out.withColumns(filled)


# Fixed values, as one table: the records that classify an owner's address, in order of precedence. A record fits by the owner's key, by its
# primary category, by what the contract's name holds (RE2), or by what any of these texts holds.
OWNERS = (
    ("DEX_OR_PROTOCOL", "OWNER_GNOSIS_SAFE_SELF_CUSTODY_PROTOCOL_GUARD", ("gnosis_safe",), (), "^gnosissafe", None),
    ("BRIDGE_BOUNDARY", "OWNER_PRIMARY_OR_CONTRACT_BRIDGE_BOUNDARY", ("arbitrum", "celer_network", "hop_protocol"), ("bridge",), "bridge", None),
    ("MIXER_BOUNDARY", "OWNER_PRIVACY_OR_MIXER_BOUNDARY", (), ("privacy services",), None, "tornado|mixer"),
    ("DEX_OR_PROTOCOL", "OWNER_DEX_PROTOCOL_OR_OPENSEA_BOUNDARY", ("cow_protocol", "opensea", "sushiswap", "symbiosis"), ("decentralized exchange",), "router|cowswap|seaport", None),
    ("SERVICE", "OWNER_DETAILS_PRIMARY_CATEGORY_CUSTODIAL_ALLOWLIST", (), ("centralized exchange", "custody services", "payment processing", "casino", "sports betting", "sports betting & prediction markets"), None, None),
)
CURATED, BRIDGE, UNMAPPED = "CURATED_NAMED_CUSTODIAL_IF_NON_GENERIC_ACTOR", "NAMED_BRIDGE", "UNMAPPED"
CEX_RULE, DEPOSIT_RULE, PERSONA_RULE = "EXPLICIT_CEX_NAMED_ADDRESS", "PROGRAMMATIC_NAMED_DEPOSIT_NOT_MANUAL_OR_LEGAL_CONFIRMATION", "PERSONA_OR_USAGE_NEVER_CONTROL_ATTRIBUTION"
MAPPED_RULE, NO_OWNER_RULE, RAW_RULE = "INHERITED_LABELS_ADDRESSES_V2:", "OWNER_METADATA_INSUFFICIENT_FOR_SERVICE_OR_PROTOCOL_ROLE", "UNMAPPED_RETAINED_RAW"
NAMELESS, BEHAVES = ";NAMED_ACTOR_REQUIRED", ";BEHAVIOR_OR_DEPLOYER_NOT_CONTROL"


def owner_names(candidates: Column) -> Column:
    """The different owners among an array of names (nulls and empty ones left out), as structs of key and name by key; of spellings of one key the
    last counts."""
    named = F.transform(F.filter(candidates, lambda v: F.coalesce(v, F.lit("")) != ""), lambda v: F.struct(canonical_actor(v)[1].alias("key"), canonical_actor(v)[0].alias("name")))
    return F.transform(F.array_sort(F.array_distinct(F.transform(named, lambda x: x["key"]))), lambda k: F.element_at(F.filter(named, lambda x: x["key"] == k), -1))


def classified(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with role, semantic_kind, actor, actor_key, record_conflict, generation_mechanism and rule. Columns, all text and all but the first two
    left out where a source lacks them: row_id, source; cex_name; name, label_type, category, record_source; owner_key, custody_owner,
    account_owner, detail_name, primary, tags, contract; distinct_name, algorithm. rules: ordinal, category, label_type, record_source (null:
    any), class; the first that fits an address label decides. No label of behaviour becomes an owner."""
    c = F.col
    absent = {n: F.lit(None).cast("string") for n in ("cex_name", "name", "label_type", "category", "record_source", "owner_key", "custody_owner", "account_owner", "detail_name", "primary", "tags", "contract", "distinct_name", "algorithm") if n not in rows.columns}
    rows = rows.withColumns(absent)
    low = lambda n: F.lower(F.coalesce(c(n), F.lit("")))
    source, label = c("source"), c("source") == "labels.addresses"
    fits = lambda r: (c("category") == r["category"]) & (r["label_type"].isNull() | (low("label_type") == r["label_type"])) & (r["record_source"].isNull() | (low("record_source") == r["record_source"]))
    # A fixed short list, as one row.
    listed = rules.groupBy().agg(F.array_sort(F.collect_list(F.struct("ordinal", "category", "label_type", "record_source", "class"))).alias("rules"))
    x = rows.join(F.broadcast(listed)).withColumn("owners", F.when(source == "labels.owner_addresses", owner_names(F.array("custody_owner", "account_owner", "detail_name"))))
    x = x.withColumn("mapped", F.when(label, F.coalesce(F.get(F.filter("rules", fits), F.lit(0))["class"], F.lit(UNMAPPED))))
    joined = F.when(F.size("owners") > 0, F.array_join(F.transform("owners", lambda o: o["name"]), " | ")).otherwise(F.coalesce("owner_key", F.lit("")))
    persona = label & low("label_type").isin("persona", "usage")
    named = label & ~persona & c("mapped").isin(CURATED, BRIDGE)
    cex, owned = source.isin("cex.addresses", "cex.deposit_addresses"), source == "labels.owner_addresses"
    x = x.withColumn("given", F.when(cex, c("cex_name")).when(named, c("name")).when(owned, joined))
    every = F.lower(F.concat_ws(" ", "owner_key", "given", "contract", "primary", "tags"))
    role, rule = F.when(cex, "SERVICE").when(named, F.when(c("mapped") == CURATED, "SERVICE").otherwise("BRIDGE_BOUNDARY")), F.when(source == "cex.addresses", CEX_RULE).when(cex, DEPOSIT_RULE).when(persona, PERSONA_RULE).when(label, F.concat(F.lit(MAPPED_RULE), "mapped"))
    for kind, why, keys, categories, contract, text in OWNERS:
        hit = low("owner_key").isin(*keys) | low("primary").isin(*categories) | (low("contract").rlike(contract) if contract else F.lit(False)) | (every.rlike(text) if text else F.lit(False))
        role, rule = role.when(owned & hit, kind), rule.when(owned & hit, why)
    x = x.withColumns({"role": role.otherwise("UNKNOWN"), "rule": rule.when(owned, NO_OWNER_RULE).otherwise(RAW_RULE)})
    actor, key = canonical_actor(c("given"))
    x = x.withColumns({"actor": actor, "key": key})
    nameless = (c("key") == "") | c("key").isin(*GENERIC)
    behaves = F.lower(F.concat_ws(" ", "name", "distinct_name", "contract")).rlike(BEHAVIOUR)
    claimed = cex | named | (owned & (c("role") != "UNKNOWN"))
    kind = F.when(behaves | persona, "BEHAVIOR").when(claimed & ~nameless, "ATTRIBUTION").otherwise("CONTEXT")
    sure = ~nameless & ~behaves
    method = F.when((source == "cex.deposit_addresses") | (F.coalesce("algorithm", F.lit("")) != "") | F.coalesce(c("record_source") == "query", F.lit(False)), "ALGORITHM_IDENTIFIED")
    return x.select(
        "row_id", "source", F.when(sure, c("role")).otherwise("UNKNOWN").alias("role"), kind.alias("semantic_kind"), F.when(sure, c("actor")).alias("actor"), F.when(sure, c("key")).alias("actor_key"),
        F.coalesce(F.size("owners") > 1, F.lit(False)).alias("record_conflict"), method.alias("generation_mechanism"),
        F.concat("rule", F.when(nameless, NAMELESS).otherwise(""), F.when(behaves, BEHAVES).otherwise("")).alias("rule"),
    )


def failed_lookups(addresses: DataFrame, sources: list[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """A failed lookup is no missing label: one FAILED opportunity per address and source, and registry rows that stay unknown."""
    opportunities = addresses.select("address", F.explode(F.array(*map(F.lit, sources))).alias("source"), F.lit("FAILED").alias("outcome"), F.lit(reason).alias("reason"))
    registry = addresses.select("address", F.lit("UNKNOWN").alias("identity_class"), F.lit(f"LOOKUP_FAILED_{reason}").alias("lookup_status"))
    return opportunities, registry


def queue(pool: DataFrame, size: int = 10, share: int = 3) -> DataFrame:
    """The next addresses to look up: by tier, then most pairs, then round robin over incidents, lexical within one; at most `share` of an
    incident in the first pass, which a second relaxes. pool: address, tier, pairs, incident.

    Candidates are cut to the first `size` of each (tier, pairs, incident) before anything meets in one place: no more of one can be
    chosen. Of these, the rank within an incident and the round robin are windows over what is left."""
    turn = F.row_number().over(Window.partitionBy("tier", "pairs", "incident").orderBy("address"))
    few = pool.withColumn("turn", turn).where(F.col("turn") <= size)
    # Of these, `share` of an incident come first; the turns of the rest begin anew.
    nth = F.row_number().over(Window.partitionBy("incident").orderBy("tier", F.desc("pairs"), "turn", "address"))
    split = few.withColumn("relaxed", nth > share)
    again = F.row_number().over(Window.partitionBy("relaxed", "tier", "pairs", "incident").orderBy("address"))
    order = ["relaxed", "tier", F.desc("pairs"), "turn", "incident", "address"]
    chosen = split.withColumn("turn", again).orderBy(*order).limit(size)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "address", "tier", "pairs", "incident", "relaxed")  # `size` rows

"""Raw text rows to events or gaps: exact integers, full hexadecimal ids, canonical trace paths. A bad row is a gap, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wide

RANK = {"top": 0, "internal": 1, "erc20": 2}


def exact_hex(value: Column, size: int) -> Column:
    """The lower-cased id of `size` bytes, null if it isn't one."""
    return F.when(value.rlike(f"^0x[0-9a-fA-F]{{{2 * size}}}$"), F.lower(value))


def exact_integer(value: Column) -> Column:
    """Digits only, without leading zeros; null else. Text, as amounts of 78 digits exceed every number type."""
    return F.when(value.rlike("^[0-9]+$"), F.regexp_replace(value, "^0+(?=[0-9])", ""))


def whole(value: Column) -> Column:
    """The decimal digits of a whole number of any length, written in decimal (white space and a plus around it do no harm) or in hexadecimal after
    0x; null else, and below zero."""
    plain = F.regexp_extract(value, r"^\s*(?:\+?0*|-0*(?=0\s*$))([0-9]+)\s*$", 1)
    hexed = F.regexp_extract(value, "^0x([0-9a-fA-F]+)$", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), wide.digits_of_hexadecimal(hexed))


def hex_or_decimal(value: Column) -> Column:
    """The same as a long, for what is no amount, such as an index; null too where it is no long."""
    return whole(value).try_cast("long")


def truth(value: Column) -> Column:
    """Whether a lenient text or boolean says true; what is missing says no."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def items(value: Column) -> Column:
    """Items of a JSON list as text (values that are no text as JSON), fields of a JSON object; none where the text is neither."""
    return F.coalesce(F.from_json(value, "array<string>"), F.json_object_keys(value), F.array().cast("array<string>"))


def seconds(value: Column) -> Column:
    """Epoch seconds of a UTC time as text, its mark of UTC written as a Z, as ' UTC' or left out; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(value, "( UTC|Z)$", ""), "T", " ")
    fits = plain.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$")
    return F.when(fits, F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), plain.try_cast("timestamp_ntz")))


def trace_path(value: Column) -> Column:
    """Places joined by underscores, of a JSON list or of such a text; null if any isn't a number, or there is none."""
    bare = F.when(value.startswith("["), F.regexp_replace(F.regexp_replace(value, r"^\[|\]$|\s", ""), ",", "_")).otherwise(value)
    return F.when(bare.rlike("^[0-9]+(_[0-9]+)*$"), F.array_join(F.transform(F.split(bare, "_"), exact_integer), "_"))


def physical_key(chain: Column, tx: Column, kind: Column, log: Column, path: Column) -> Column:
    """Chain, transaction and position: where a fact is, whatever its id says."""
    return F.concat_ws("|", chain, tx, F.when(kind == "top", "top").when(kind == "erc20", F.concat(F.lit("log:"), log)).otherwise(F.concat(F.lit("trace:"), path)))


def normalised(rows: DataFrame) -> DataFrame:
    """Rows (row_id and raw texts) with canonical fields and gap, the first reason that keeps a row from being an event, or null."""
    c = F.col
    df = rows.withColumns(
        {
            "tx": exact_hex(c("tx_hash"), 32),
            "from": exact_hex(c("sender"), 20),
            "to": exact_hex(c("recipient"), 20),
            "amount": exact_integer(c("amount_raw")),
            "at_block": exact_integer(c("block")).try_cast("long"),
            "log": exact_integer(c("log_index")),
            "trace": trace_path(c("trace_address")),
            "token": exact_hex(c("contract"), 20),
            "gas": F.when(c("kind") == "top", wide.product(exact_integer(c("gas_used")), exact_integer(c("gas_price")))),
        }
    )
    gap = (
        F.when(c("tx").isNull(), "TX_HASH")
        .when(c("success").isNull(), "SUCCESS_UNRESOLVED")
        .when(c("from").isNull() | c("to").isNull(), "ADDRESS")
        .when(~c("kind").isin(*RANK), "UNKNOWN_KIND")
        .when((c("kind") == "internal") & c("trace").isNull(), "TRACE_LOCATOR")
        .when((c("kind") == "internal") & c("call_type").isin("delegatecall", "callcode", "staticcall"), "NON_VALUE_TRACE")
        .when((c("kind") == "erc20") & c("log").isNull(), "LOG_INDEX")
        .when((c("kind") == "erc20") & c("token").isNull(), "CONTRACT")
        .when(c("amount").isNull() | c("at_block").isNull(), "INTEGER")
    )
    key = physical_key(F.lit("eip155:1"), c("tx"), c("kind"), c("log"), c("trace"))
    asset = F.when(c("kind") == "erc20", F.concat(F.lit("erc20:eip155:1:"), c("token"))).otherwise("native:eip155:1")
    return df.withColumns({"gap": gap, "key": key, "asset": asset, "event_id": F.concat(F.lit("eip155:1:tx:"), c("tx"), F.lit(":"), F.element_at(F.split(key, r"\|"), 3))})


# Why a row of an account list is no event.
NO_IDENTITY, NO_STATUS, FAILED = "EVENT_IDENTITY_UNRESOLVED", "INTERNAL_STATUS_UNRESOLVED", "NORMALIZATION_FAILED"
#: The kind of each account list.
LISTS = {"txlist": "top", "txlistinternal": "internal", "tokentx": "erc20"}


def listed(action: str, rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows of one account list (see LISTS) as events, or with gap, the reason that keeps them from it. All columns are raw text, null where the
    row lacks them: row_id, tx_hash, tx_index, is_error, receipt_status, gas_used, gas_price, trace_id, log_index, contract, sender, recipient,
    value, block, time. Numbers may be hexadecimal and of any length; an empty one is unknown, one that can't be read fails the row, in the
    order in which a row is read. Indexes that a row lacks come from positions (tx_hash, tx_index)."""
    c, kind = F.col, LISTS[action]
    given = lambda name: c(name).isNotNull() & (c(name) != "")
    wrong = lambda when: F.when(F.coalesce(when, F.lit(False)), FAILED)
    numbers = ["tx_index", "value", "block", "time", *{"top": ["gas_used", "gas_price"], "internal": [], "erc20": ["log_index"]}[kind]]
    index = positions.select(F.col("tx_hash").alias("_tx"), F.col("tx_index").cast("long").alias("_index"))
    df = rows.withColumns({"tx": F.lower("tx_hash"), "value": F.coalesce("value", F.lit("0")), **{f"n_{n}": whole(F.coalesce(c(n), F.lit("0")) if n == "value" else c(n)) for n in numbers}, "path": trace_path(c("trace_id"))})
    df = df.join(index, F.col("tx") == F.col("_tx"), "left")
    unread = lambda name: given(name) & c(f"n_{name}").isNull()
    failed = (F.coalesce(c("is_error"), F.lit("0")) != "0") | (F.coalesce(c("receipt_status"), F.lit("1")) == "0")
    first = wrong(c("tx").isNull() | ~c("tx").startswith("0x") | (F.length("tx") != 66) | unread("tx_index"))
    to = F.when(given("recipient"), c("recipient")).otherwise(F.coalesce("contract", F.lit("")))
    last = unread("value") | c("block").isNull() | unread("block") | c("time").isNull() | unread("time") | (F.length(F.coalesce("sender", F.lit(""))) != 42) | (F.length(to) != 42)
    asset, gas, log, place = F.lit("native:eip155:1"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit("top")
    if kind == "top":
        has_gas = given("gas_used") & given("gas_price")
        own = wrong(has_gas & (unread("gas_used") | unread("gas_price")))
        gas = F.when(has_gas, wide.product(c("n_gas_used"), c("n_gas_price")))
    elif kind == "internal":
        own = F.when(c("trace_id").isNull(), NO_IDENTITY).when(c("is_error").isNull(), NO_STATUS)
        last, place = last | c("path").isNull(), F.concat(F.lit("trace:"), c("trace_id"))
    else:
        own = F.coalesce(wrong(unread("log_index")), F.when(~given("log_index"), NO_IDENTITY), wrong(F.coalesce(F.length("contract"), F.lit(0)) != 42))
        own = F.coalesce(F.when(c("log_index").isNull(), NO_IDENTITY), own)
        asset, log, place = F.concat(F.lit("erc20:eip155:1:"), F.lower("contract")), c("n_log_index").try_cast("long"), F.concat(F.lit("log:"), c("n_log_index"))
    return df.select(
        F.lit(action).alias("action"), "row_id", F.coalesce(first, own, wrong(last)).alias("gap"), F.lower(F.concat(F.lit("eip155:1:tx:"), c("tx"), F.lit(":"), place)).alias("event_id"), F.lit(kind).alias("kind"), "tx",
        F.lower("sender").alias("sender"), F.lower(to).alias("recipient"), asset.alias("asset"), c("n_value").alias("amount"), c("n_block").try_cast("long").alias("block"),
        F.coalesce(c("n_tx_index").try_cast("long"), "_index").alias("tx_index"), c("n_time").try_cast("long").alias("tsec"), log.alias("log"), F.when(F.lit(kind == "internal"), c("path")).alias("trace"), (~failed).alias("success"), gas.alias("gas"),
    )

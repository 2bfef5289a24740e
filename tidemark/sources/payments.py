"""Payments from files and from the test tables, in one schema.

A payment has id, dt (seconds), amount, product_code, card1, card_network,
card_type, billing_region, billing_country_code, distance,
purchaser_email_domain, recipient_email_domain, d1, device_type, device_info
and is_fraud (-1 for unknown). Missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import normalised, number, text

#: dt counts seconds from this instant (2017-12-01 UTC), in Unix seconds.
EPOCH = 1_512_086_400

#: Columns of a transactions file (fixed names): what each becomes, and its type.
TRANSACTION = {
    "TransactionID": ("id", "bigint"),
    "TransactionDT": ("dt", "bigint"),
    "TransactionAmt": ("amount", "double"),
    "ProductCD": ("product_code", "string"),
    "card1": ("card1", "double"),
    "card4": ("card_network", "string"),
    "card6": ("card_type", "string"),
    "addr1": ("billing_region", "double"),
    "addr2": ("billing_country_code", "double"),
    "dist1": ("distance", "double"),
    "P_emaildomain": ("purchaser_email_domain", "string"),
    "R_emaildomain": ("recipient_email_domain", "string"),
    "D1": ("d1", "double"),
}
IDENTITY = {"TransactionID": ("id", "bigint"), "DeviceType": ("device_type", "string"), "DeviceInfo": ("device_info", "string")}
COLUMNS = (*(new for new, _ in TRANSACTION.values()), "device_type", "device_info", "is_fraud")


class SchemaError(ValueError):
    """A file lacks a column, or holds what its column can't."""


def _strict(name: str, kind: str) -> Column:
    """The column as its type; a value that isn't one fails the job and names itself."""
    raw = F.col(f"`{name}`")
    if kind == "string":
        return text(raw)
    # whole numbers may be written with a fraction of zeros
    value = raw.try_cast("double")
    bad = F.coalesce(raw, F.lit("")) != ""
    if kind == "bigint":
        whole = raw.try_cast("bigint")
        value = F.coalesce(whole, F.when(value == F.floor(value), value.cast("bigint")))
    else:
        value = number(value)
    failed = F.raise_error(F.concat(F.lit(f"{name}: not a {'whole number' if kind == 'bigint' else 'number'}: "), raw))
    infinite = F.lower(F.trim(raw)).isin("nan", "+nan", "-nan")
    return F.when(bad & value.isNull() & ~infinite, failed.cast(kind)).otherwise(value)


def _read(spark: SparkSession, path: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    missing = [c for c in wanted if c not in raw.columns]
    if missing:
        raise SchemaError(f"{path} has no column {', '.join(missing)}")
    return raw


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Payments of a CSV file, located by header; other columns are not parsed."""
    raw = _read(spark, path, TRANSACTION)
    required = {"id", "dt"}
    columns = []
    for name, (new, kind) in TRANSACTION.items():
        value = _strict(name, kind)
        if new in required:
            value = F.coalesce(value, F.raise_error(F.lit(f"{name} is empty")).cast(kind))
        columns.append(value.alias(new))
    fraud = F.lit(-1).cast("tinyint")
    if "isFraud" in raw.columns:
        flag = F.coalesce(F.col("isFraud"), F.lit(""))
        wrong = F.raise_error(F.concat(F.lit("isFraud: neither 0 nor 1: "), flag)).cast("tinyint")
        fraud = F.when(flag == "", fraud).when(flag.isin("0", "1"), flag.cast("tinyint")).otherwise(wrong)
    return raw.select(*columns, fraud.alias("is_fraud"))


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    """Devices by payment id. An id that comes twice fails the job."""
    rows = _read(spark, path, IDENTITY).select(*[_strict(n, k).alias(new) for n, (new, k) in IDENTITY.items()])
    once = rows.groupBy("id").agg(F.count("*").alias("_n"), F.max("device_type").alias("device_type"), F.max("device_info").alias("device_info"))
    twice = F.raise_error(F.concat(F.lit("identity given twice: "), F.col("id").cast("string"))).cast("bigint")
    return once.select(F.when(F.col("_n") > 1, twice).otherwise(F.col("id")).alias("id"), "device_type", "device_info")


def with_identity(payments: DataFrame, identity: DataFrame) -> DataFrame:
    """payments with the device columns of identity; an identity without payment is ignored."""
    return payments.join(identity, "id", "left").select(*COLUMNS)


def load(spark: SparkSession, transactions: str, identity: str | None = None) -> DataFrame:
    """Payments of both files, joined and checked for their order."""
    rows = read_transactions(spark, transactions)
    if identity:
        return ordered(with_identity(rows, read_identity(spark, identity)))
    return ordered(rows.withColumns({"device_type": F.lit(None).cast("string"), "device_info": F.lit(None).cast("string")}).select(*COLUMNS))


def ordered(payments: DataFrame) -> DataFrame:
    """payments, failing the job where two have the same (dt, id). They are not sorted: nothing that follows needs it.

    Only those two columns are shuffled; what comes of it is one row.
    """
    twice = F.raise_error(F.concat(F.lit("two payments at one place: "), F.min("id").cast("string"))).cast("boolean")
    once = order_faults(payments).agg(F.when(F.count("*") > 0, twice).otherwise(True).alias("_once"))
    return payments.join(F.broadcast(once)).filter("_once").drop("_once")


def order_faults(payments: DataFrame) -> DataFrame:
    """(dt, id, n) of places that more than one payment claims."""
    return payments.groupBy("dt", "id").agg(F.count("*").alias("n")).filter("n > 1")


# -- payments of the test tables ------------------------------------------------

EVENTS_SQL = f"""
SELECT event_id AS id, {{seconds}} - {EPOCH} AS dt, value AS amount, event_type AS product_code, CAST(user_id AS DOUBLE) AS card1,
 CASE WHEN user_id % 3 = 0 THEN 'visa' WHEN user_id % 3 = 1 THEN 'mastercard' ELSE 'discover' END AS card_network,
 CASE WHEN user_id % 2 = 0 THEN 'credit' ELSE 'debit' END AS card_type,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(100 + user_id % 9 AS DOUBLE) END AS billing_region,
 CASE WHEN event_id % 13 = 0 THEN 60.0E0 ELSE 87.0E0 END AS billing_country_code,
 CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 200 AS DOUBLE) END AS distance,
 CASE user_id % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.com' WHEN 2 THEN 'Anonymous.com' ELSE NULL END AS purchaser_email_domain,
 CASE WHEN event_id % 7 < 3 THEN 'gmail.com' WHEN event_id % 7 < 5 THEN 'mail.com' ELSE NULL END AS recipient_email_domain,
 CAST(user_id % 30 AS DOUBLE) AS d1,
 CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('dev', CAST(event_id % 7 AS VARCHAR(20))) END AS device_info,
 CAST(CASE WHEN event_id % 29 = 0 THEN 1 WHEN event_id % 17 = 0 THEN -1 ELSE 0 END AS TINYINT) AS is_fraud
FROM events"""

ORDERS_SQL = f"""
SELECT o_orderkey AS id, {{seconds}} - {EPOCH} AS dt, o_totalprice AS amount, o_orderstatus AS product_code, CAST(o_custkey AS DOUBLE) AS card1,
 c_mktsegment AS card_network, CAST(NULL AS VARCHAR(20)) AS card_type, CAST(c_nationkey AS DOUBLE) AS billing_region, CAST(n_regionkey AS DOUBLE) AS billing_country_code,
 CAST(NULL AS DOUBLE) AS distance, n_name AS purchaser_email_domain, CAST(NULL AS VARCHAR(20)) AS recipient_email_domain, CAST(o_custkey % 10 AS DOUBLE) AS d1,
 CAST(NULL AS VARCHAR(20)) AS device_type, o_orderpriority AS device_info, CAST(CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS TINYINT) AS is_fraud
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

_SPARK_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"
_DUCK_SECONDS = "CAST(floor(epoch({})) AS BIGINT)"


def _from_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:  # names in the query stand for the frames given with it
        sql = sql.replace(f" {t} ", f" {{{t}}} ").replace(f" {t}\n", f" {{{t}}}\n")
        if sql.endswith(f" {t}"):
            sql = sql[: -len(t)] + f"{{{t}}}"
    return spark.sql(sql, **frames)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = EVENTS_SQL.format(seconds=_SPARK_SECONDS.format("ts"))
    return normalised(_from_sql(spark, sf_dir, sql, "events"))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = ORDERS_SQL.format(seconds=_SPARK_SECONDS.format("o_orderdate"))
    return normalised(_from_sql(spark, sf_dir, sql, "orders", "customer", "nation"))


def events_sql() -> str:
    return EVENTS_SQL.format(seconds=_DUCK_SECONDS.format("ts"))


def orders_sql() -> str:
    return ORDERS_SQL.format(seconds=_DUCK_SECONDS.format("o_orderdate"))

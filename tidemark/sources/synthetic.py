"""Made-up payments with three kinds of fraud, drawn by hashes so that any part can be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import FIELDS, NUMBER
from tidemark.sources.payments import COLUMNS

DAY = 86_400

# Numbers at the borders of what doubles hold, and letters whose lower case is special.
EDGE_NUMBERS = [0.0, -0.0, 5e-324, 1e-300, 0.3, 0.1 + 0.2, 49.99, 1e15, 1e308, -1e308, 9007199254740992.0, float("inf"), float("-inf")]
EDGE_STRINGS = ["\u212a", "\u0130stanbul", "\u1e9e", "\u01c5", "\u03a3\u0391\u03a3", " ", "VISA"]
COMMON_STRINGS = ["visa", "credit", "gmail.com", "mail.com", "purchase", "dev-1", "mobile"]


def draw(name: str, *of: Column | str, seed: int = 7) -> Column:
    """A number in [0, 1) for each value of the columns."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), *of), F.lit(1 << 30)) / float(1 << 30)


def pick(u: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def generate(spark: SparkSession, rows: int = 590_540, days: int = 182, fraud: float = 0.035, customers: int | None = None, seed: int = 7) -> DataFrame:
    """`rows` payments over `days` days.

    Fraud, a share of `fraud`, is of three kinds: card testing (bursts of small
    amounts on one card within minutes), takeovers (a known customer's card on a new device,
    for much more than usual) and risky combinations of raw fields. A like share
    of honest payments looks the same: bursts of small top-ups, new
    devices of travellers, and those same fields.
    """
    customers = customers or max(1, rows // 8)
    u = lambda name, *of: draw(name, *(of or ("id",)), seed=seed)
    df = spark.range(1, rows + 1).withColumn("_u", u("kind")).withColumn("_odd", F.col("_u") < 2 * fraud)
    df = df.withColumn("_fraud", F.col("_u") < fraud).withColumn("_kind", F.when(F.col("_odd"), F.when(u("which") < 0.4, 1).when(u("which") < 0.7, 2).otherwise(3)).otherwise(0))
    burst = F.floor(F.col("id") / 6)
    df = df.withColumn("_who", F.when(F.col("_kind") == 1, F.floor(u("burst card", burst) * customers)).otherwise(F.floor(F.pow(u("who"), 1.5) * customers)).cast("bigint"))
    spread = F.floor(u("time") * days * DAY)
    df = df.withColumn("dt", F.when(F.col("_kind") == 1, F.floor(u("burst time", burst) * days * DAY) + F.floor(u("within") * 600)).otherwise(spread).cast("bigint") + DAY)
    usual = 20 + 180 * u("usual", "_who")
    amount = F.when(F.col("_kind") == 1, 1 + 4 * u("small")).when(F.col("_kind") == 2, usual * (4 + 6 * u("large"))).otherwise(usual * (0.4 + 1.2 * u("amount")))
    home = F.concat(F.lit("device-"), (F.floor(u("device", "_who") * 400)).cast("string"))
    new = F.concat(F.lit("device-"), (F.floor(u("new device") * 4000) + 400).cast("string"))
    missing = lambda name, share, c: F.when(u(name) >= share, c)
    risky = F.col("_kind") == 3
    df = df.withColumns({
        "amount": F.round(amount, 2), "card1": (1000 + F.col("_who")).cast("double"), "product_code": F.when(risky, "C").otherwise(pick(u("product"), ["W", "W", "W", "H", "R", "S"])),
        "card_network": pick(u("network", "_who"), ["visa", "visa", "mastercard", "discover"]), "card_type": F.when(risky, "credit").otherwise(pick(u("type", "_who"), ["debit", "debit", "credit"])),
        "billing_region": missing("region?", 0.1, F.floor(100 + 400 * u("region", "_who")).cast("double")), "billing_country_code": missing("country?", 0.1, F.when(u("abroad") < 0.02, 60.0).otherwise(87.0)),
        "distance": missing("distance?", 0.6, F.floor(300 * u("distance")).cast("double")), "purchaser_email_domain": missing("email?", 0.15, pick(u("email", "_who"), ["gmail.com", "gmail.com", "yahoo.com", "hotmail.com", "anonymous.com"])),
        "recipient_email_domain": F.when(risky, "gmail.com").otherwise(missing("recipient?", 0.75, pick(u("recipient"), ["gmail.com", "yahoo.com"]))), "d1": missing("d1?", 0.05, F.floor(u("d1", "_who") * 300) + F.floor(F.col("dt") / DAY)).cast("double"),
        "device_type": missing("device?", 0.3, pick(u("device type"), ["mobile", "desktop"])), "device_info": missing("device?", 0.3, F.when(F.col("_kind") == 2, new).otherwise(home)), "is_fraud": F.col("_fraud").cast("tinyint"),
    })
    return df.select(*COLUMNS)


def md5_number(text: Column) -> Column:
    """A number below 2**32 for each text: one that other engines can work out too."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def feature_table(spark: SparkSession, rows: int, days: int = 182, missing: float = 0.1, edge: float = 0.2, seed: int = 7, ids: DataFrame | None = None) -> DataFrame:
    """A feature table of drawn fields for comparing evaluators: a share of each field is missing, another one takes edge values.

    Each value depends on the seed, its row and its field alone. Fraud grows with risk_score.
    ids: rows (_row) to draw for instead of 0 to rows - 1.
    """

    def number(name: str) -> Column:
        return md5_number(F.concat(F.lit(f"{seed}:{name}:"), F.col("_row").cast("string")))

    df = spark.range(rows).withColumnRenamed("id", "_row") if ids is None else ids.select("_row")
    columns = []
    for f in FIELDS:
        kind, value = number(f.name) % 1_000, number(f"{f.name}=")
        edges, usual = (EDGE_NUMBERS, value % 20_000 / 100.0) if f.kind == NUMBER else (EDGE_STRINGS, listed(value, COMMON_STRINGS))
        if f.name == "risk_score":
            edges, usual = [0.0, 99.0], (value % 100).cast("double")
        columns.append(F.when(kind < int(missing * 1_000), F.lit(None)).when(kind < int((missing + edge) * 1_000), listed(value, edges)).otherwise(usual).alias(f.name))
    step = (F.floor(F.col("_row") * (days * DAY) / max(rows, 1)) + DAY).cast("bigint")
    df = df.select((F.col("_row") + 3_000_000).alias("id"), step.alias("dt"), *columns, "_row")
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0)) / 99
    fraud = number("fraud") % 1_000 < 5 + F.floor(120 * risk * risk * risk)
    return df.select("id", "dt", fraud.cast("tinyint").alias("fraud"), F.lit(None).cast("bigint").alias("label_time"), *[f.name for f in FIELDS])


def listed(value: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (value % len(values)).cast("int"))

"""Payments, events and decisions as JSON records, and signed deliveries.

Bad records never stop a stream: each decoder adds an error column, null where
the record is good, so that callers split good records from dead letters.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType

from tidemark.catalog import FIELDS, NUMBER
from tidemark.operators.labels import CLOSED, CREATED, SUCCEEDED, payment_number
from tidemark.sources.payments import EPOCH

#: Keys of risk_fields (fixed names): the payment's column and whether it is a number.
RISK_FIELDS = {
    "product_code": ("product_code", False), "card1": ("card1", True), "card4": ("card_network", False), "card6": ("card_type", False),
    "addr1": ("billing_region", True), "addr2": ("billing_country_code", True), "dist1": ("distance", True), "P_emaildomain": ("purchaser_email_domain", False),
    "R_emaildomain": ("recipient_email_domain", False), "DeviceType": ("device_type", False), "DeviceInfo": ("device_info", False), "D1": ("d1", True),
    "TransactionAmt": ("transaction_amt", True),
}
#: The first second after the year 2999.
YEAR_3000 = 32_503_680_000
MAX_AHEAD = 86_400

_PAYMENT = "payment_id string, created string, amount string, currency string, is_fraud string, risk_fields string"


def decode_payments(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw with payment_id, created, the payment's columns, and error.

    Numbers must be finite JSON numbers and texts JSON strings; null, absent
    and empty are missing. A key of risk_fields that isn't known is an error,
    as it would turn a value into a missing one unnoticed. The exact
    TransactionAmt beats amount, which is in cents.
    """
    r, v = F.col("_r"), F.try_parse_json(F.col(column))
    df = raw.withColumn("_v", v).withColumn("_r", F.from_json(F.col(column), _PAYMENT))
    fields = F.try_variant_get(F.col("_v"), "$.risk_fields", "map<string,variant>")
    df = df.withColumn("_f", F.coalesce(fields, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))))
    known = F.array(*[F.lit(k) for k in RISK_FIELDS])
    unknown = F.array_sort(F.array_except(F.map_keys("_f"), known))
    kinds, columns = [], {}
    for key, (name, is_number) in RISK_FIELDS.items():
        kind = F.schema_of_variant(F.element_at("_f", key))
        wrong = ~kind.isin("VOID") & (~kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$") if is_number else kind != "STRING")
        kinds.append(F.when(F.coalesce(wrong, F.lit(False)), F.lit(f"risk_fields.{key} is not a {'number' if is_number else 'text'}")))
        got = F.try_variant_get(F.element_at("_f", key), "$", "double" if is_number else "string")
        columns[name] = F.nanvl(got, F.lit(None).cast("double")) if is_number else F.nullif(got, F.lit(""))
    created, cents = r["created"].try_cast("bigint"), r["amount"].try_cast("double")
    error = F.coalesce(
        F.when(F.col("_v").isNull() | r.isNull(), F.lit("not a JSON object")),
        F.when(F.coalesce(r["payment_id"], F.lit("")) == "", F.lit("payment_id is missing")),
        F.when(F.coalesce(created, F.lit(0)) <= 0, F.lit("created is missing")),
        F.when(created >= YEAR_3000, F.lit("created lies after the year 2999")),
        F.when(F.coalesce(cents, F.lit(0.0)) < 0, F.lit("amount is negative")),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown risk_fields: "), F.array_join(unknown, ", "))),
        *kinds,
    )
    out = df.withColumns({"error": error, "payment_id": r["payment_id"], "created": created, "_cents": cents, "_fraud": r["is_fraud"].try_cast("tinyint")} | columns)
    amount = F.coalesce(F.col("transaction_amt"), F.coalesce(F.col("_cents"), F.lit(0.0)) / 100.0)
    return out.withColumns({
        "amount": amount, "id": F.coalesce(payment_number("payment_id"), F.lit(0)), "dt": F.col("created") - EPOCH, "is_fraud": F.coalesce(F.col("_fraud"), F.lit(-1).cast("tinyint"))
    }).drop("_v", "_r", "_f", "_cents", "_fraud", "transaction_amt")


def good(decoded: DataFrame) -> DataFrame:
    return decoded.filter("error IS NULL").drop("error")


def dead(decoded: DataFrame, column: str = "value") -> DataFrame:
    return decoded.filter("error IS NOT NULL").select(column, "error")


def not_ahead(created: Column, latest: Column, ahead: int = MAX_AHEAD) -> Column:
    """Whether an event time is at most `ahead` beyond the later of latest and now; a far one would hold its keys for good."""
    return created <= F.greatest(latest, F.unix_timestamp()) + ahead


_EVENT = "id string, object string, type string, created bigint, data struct<object:struct<id:string,object:string,payment_intent:string,amount:bigint,reason:string,status:string>>"


def decode_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw with event_id, type, created, payment_id, dispute_id, reason, status, amount and error, from event envelopes."""
    e = F.from_json(F.col(column), _EVENT)
    o = F.col("_e.data.object")
    paid = F.col("_e.type") == SUCCEEDED
    df = raw.withColumn("_e", e)
    error = F.coalesce(
        F.when(F.col("_e.id").isNull() | F.col("_e.type").isNull() | F.col("_e.created").isNull(), F.lit("not an event")),
        F.when(~F.col("_e.type").isin(SUCCEEDED, CREATED, CLOSED), F.concat(F.lit("unknown type "), F.col("_e.type"))),
        F.when(o.isNull() | o["id"].isNull(), F.lit("the event has no object")),
    )
    return df.withColumns({
        "error": error, "event_id": F.col("_e.id"), "type": F.col("_e.type"), "created": F.col("_e.created"), "payment_id": F.when(paid, o["id"]).otherwise(o["payment_intent"]),
        "dispute_id": F.when(~paid, o["id"]), "reason": o["reason"], "status": o["status"], "amount": o["amount"],
    }).drop("_e")


# -- decisions --------------------------------------------------------------------

DECISION = StructType([
    StructField("assessment_id", StringType()), StructField("payment_id", StringType()), StructField("created", LongType()), StructField("at_ms", LongType()),
    StructField("ruleset_version", LongType()), StructField("decision", StringType()), StructField("rule_id", StringType()), StructField("shadow_matches", ArrayType(StringType())),
    StructField("scored", BooleanType()), StructField("risk_score", LongType()), StructField("probability", DoubleType()), StructField("raw_score", DoubleType()),
    StructField("latency_us", DoubleType()), StructField("catalog", StringType()), StructField("model_sha256", StringType()), StructField("features", ArrayType(StringType())),
    StructField("bias", DoubleType()), StructField("contributions", MapType(StringType(), DoubleType())),
])
#: Columns that say when a decision was written, not what it was.
WRITTEN = ("at_ms", "latency_us")


def catalog_stamp() -> str:
    return hashlib.sha256(",".join(f"{f.name}:{f.kind}" for f in FIELDS).encode()).hexdigest()[:16]


def decisions(decided: DataFrame, version: int, model_sha256: str = "", at_ms: Column | None = None) -> DataFrame:
    """Decision records of decided payments; ids depend on the payment alone, so a record made twice is the same."""
    name = F.concat(F.lit("txn_"), F.col("id").cast("string"))
    values = [F.col(f.name).cast("string") for f in FIELDS]
    columns = set(decided.columns)
    optional = lambda c, kind: (F.col(c) if c in columns else F.lit(None)).cast(kind).alias(c)
    return decided.select(
        F.concat(F.lit("as_"), F.substring(F.sha2(name, 256), 1, 24)).alias("assessment_id"), name.alias("payment_id"), (F.col("dt") + EPOCH).alias("created"),
        (at_ms if at_ms is not None else F.lit(0)).cast("bigint").alias("at_ms"), F.lit(version).cast("bigint").alias("ruleset_version"), F.col("action").alias("decision"),
        "rule_id", "shadow_matches", F.col("risk_score").isNotNull().alias("scored"), F.coalesce(F.col("risk_score"), F.lit(0)).cast("bigint").alias("risk_score"),
        optional("probability", "double"), optional("raw_score", "double"), F.lit(0.0).alias("latency_us"), F.lit(catalog_stamp()).alias("catalog"), F.lit(model_sha256).alias("model_sha256"),
        F.array(*values).alias("features"), optional("bias", "double"), optional("contributions_map", "map<string,double>").alias("contributions"),
    )


#: The kinds of JSON values that a column of some type is read from.
_KINDS = {"string": "STRING", "bigint": "BIGINT", "double": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN"}


def _is_decision(line: Column) -> Column:
    """Whether a line is a JSON object that names a payment, with a value of its own type, or none, for every field of a decision."""
    v = F.try_parse_json(line)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    is_a = lambda x, names: kind(x).rlike(f"^({names}|VOID)$")
    of_kind = lambda names: lambda x: is_a(x, names)
    sound = F.startswith(F.ltrim(line), F.lit("{")) & v.isNotNull() & (F.coalesce(F.try_variant_get(v, "$.payment_id", "string"), F.lit("")) != "")
    for f in DECISION:
        value = F.try_variant_get(v, f"$.{f.name}", "variant")
        if isinstance(f.dataType, ArrayType):
            # a feature may be a text or a number
            names = _KINDS["string"] + ("|" + _KINDS["double"] if f.name == "features" else "")
            good = kind(value).rlike("^(ARRAY<.*|VOID)$") & F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), of_kind(names)), F.lit(True))
        elif isinstance(f.dataType, MapType):
            good = kind(value).rlike("^(OBJECT<.*|VOID)$") & F.coalesce(F.forall(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), lambda x: kind(x).rlike(f"^({_KINDS['double']})$")), F.lit(True))
        else:
            good = is_a(value, _KINDS[f.dataType.simpleString()])
        sound = sound & good
    return F.coalesce(sound, F.lit(False))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decision records of JSON lines. Only a last line without its end may be torn, and is then left out; any other bad line is an error.

    A line is bad if it isn't a JSON object, names no payment, or has a value of
    another type than its field's; fields that are absent or null are null.
    Lines are looked through once before any is returned. A file's last line is
    the last one of its last part: within a part Spark numbers lines in order.
    It lacks its end if the file is one byte shorter than its lines with theirs
    (of a compressed file that isn't known, so there no line may be bad).
    """
    lines = spark.read.text(path, wholetext=False, lineSep="\n")
    empty = F.trim("value") == ""
    bad = ~empty & ~_is_decision(F.col("value"))
    parses = F.try_parse_json("value").isNotNull()
    placed = lines.select("value", bad.alias("bad"), (bad & ~parses).alias("broken"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("whole"), (F.octet_length("value") + 1).alias("size"), F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line")).alias("place"))
    cut = F.sum("size") == F.max("whole") + 1
    files = placed.groupBy("file").agg((F.max_by("broken", "place") & cut).alias("torn"), F.count_if("bad").alias("n"), F.min(F.when(F.col("bad"), F.struct("place", "value"))).alias("first"))
    wrong = files.filter(F.col("n") > F.col("torn").cast("int")).select("file", F.col("n") - F.col("torn").cast("int"), F.substring("first.value", 1, 80)).first()
    if wrong:
        raise ValueError(f"{wrong[0]}: {wrong[1]} lines are not a decision, first {wrong[2]!r}")
    return lines.filter(~bad & ~empty).select(F.from_json("value", DECISION, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")


def in_event_order(log: DataFrame) -> DataFrame:
    """Decisions by time, then number of payment (those without one first), then name: ranges of them in parallel."""
    return log.orderBy("created", F.coalesce(payment_number("payment_id"), F.lit(-1)), "payment_id")


def feature_columns(log: DataFrame) -> DataFrame:
    """log with each catalog field as a column, from its place in features."""
    place = lambda i, f: F.get("features", F.lit(i)).cast("double" if f.kind == NUMBER else "string").alias(f.name)
    kept = [c for c in log.columns if c not in ("features", "risk_score")]
    return log.select(*kept, F.col("risk_score").alias("logged_risk"), *[place(i, f) for i, f in enumerate(FIELDS)])


def table_from_log(log: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A feature table of logged payments, with labels (payment_id, arrived_dt) as fraud; others are legitimate."""
    df = feature_columns(log).withColumns({"id": F.coalesce(payment_number("payment_id"), F.lit(0)), "dt": F.col("created") - EPOCH})
    if labels is None:
        df = df.withColumns({"fraud": F.lit(-1).cast("tinyint"), "label_time": F.lit(None).cast("bigint")})
    else:
        df = df.join(labels.select("payment_id", "arrived_dt"), "payment_id", "left")
        df = df.withColumns({"fraud": F.col("arrived_dt").isNotNull().cast("tinyint"), "label_time": F.col("arrived_dt")})
    return df.select("id", "dt", "fraud", "label_time", *[f.name for f in FIELDS])


def decision_set(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per payment its first record by `order`, with duplicates (further records) and conflicts (those that say otherwise)."""
    said = [c for c in log.columns if c not in WRITTEN and c not in order]
    content = F.xxhash64(*[F.to_json(c) if isinstance(log.schema[c].dataType, (MapType, ArrayType)) else F.col(c) for c in said])
    df = log.withColumn("_said", content)
    place = F.struct(*order)
    row = F.struct(*[c for c in log.columns if c != "payment_id"])
    # first by what is said, then by payment: one pass, and each record counts once
    each = df.groupBy("payment_id", "_said").agg(F.min(place).alias("_at"), F.min_by(row, place).alias("x"), F.count("*").alias("_m"))
    whole = each.groupBy("payment_id").agg(F.min_by(F.struct("x", "_m"), "_at").alias("f"), F.sum("_m").alias("_n"))
    return whole.select("payment_id", "f.x.*", (F.col("_n") - 1).alias("duplicates"), (F.col("_n") - F.col("f._m")).alias("conflicts"))


# -- signed deliveries ------------------------------------------------------------

TOLERANCE = 300
MALFORMED, UNSIGNED, STALE = "malformed_header", "no_matching_signature", "timestamp_outside_tolerance"
_STAMP = re.compile(r"[0-9]{1,15}\Z")


def sign(secret: bytes, payload: bytes, t: int) -> str:
    return f"t={t},v1={hmac.new(secret, f'{t}.'.encode() + payload, hashlib.sha256).hexdigest()}"


def signature_error(header: str | None, payload: bytes, secrets: Sequence[bytes], now: int, tolerance: int = TOLERANCE) -> str | None:
    """Why a delivery is refused, or None.

    The header is items key=value between commas: t once, of at most fifteen
    digits; v1 once or more, not empty; other keys mean nothing. Any secret
    may match any v1. The time is looked at only once a signature matches.
    """
    stamps, given = [], []
    for item in (header or "").split(","):
        key, eq, value = item.strip(" \t").partition("=")
        if not eq or not key:
            return MALFORMED
        if key == "t":
            stamps.append(value)
        elif key == "v1":
            given.append(value)
    if len(stamps) != 1 or not _STAMP.match(stamps[0]) or not given or "" in given:
        return MALFORMED
    if not secrets or not all(secrets):
        return UNSIGNED
    wanted = [hmac.new(s, stamps[0].encode() + b"." + payload, hashlib.sha256).hexdigest().encode() for s in secrets]
    if not any(hmac.compare_digest(w, g.encode("utf-8", "surrogatepass")) for g in given for w in wanted):
        return UNSIGNED
    return STALE if abs(now - int(stamps[0])) > (tolerance if tolerance > 0 else TOLERANCE) else None


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """The HMAC of a message under a fixed secret, in hexadecimal: two hashes over the secret's two pads."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda n: F.lit(bytes(b ^ n for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signed(secret: bytes, payload: Column, t: Column) -> Column:
    """sign() as built-in functions."""
    return F.concat(F.lit("t="), t.cast("string"), F.lit(",v1="), hmac_sha256(secret, F.concat(F.concat(t.cast("string"), F.lit(".")).cast("binary"), payload.cast("binary"))))


def verify(df: DataFrame, secrets: Sequence[bytes], header: str = "header", payload: str = "payload", now: str = "now", tolerance: int = TOLERANCE) -> DataFrame:
    """df with signature_error, null for deliveries that are good: what signature_error() says of each, as built-in functions."""
    items = F.transform(F.split(F.coalesce(F.col(header), F.lit("")), ","), lambda x: F.btrim(x, F.lit(" \t")))
    of = lambda key: F.transform(F.filter(items, lambda x: F.startswith(x, F.lit(f"{key}="))), lambda x: F.substring(x, len(key) + 2, 1 << 30))
    stamps, given = of("t"), of("v1")
    odd = F.exists(items, lambda x: ~x.rlike("^[^=]+=")) | (F.size(stamps) != 1) | ~F.coalesce(F.get(stamps, F.lit(0)).rlike("^[0-9]{1,15}$"), F.lit(False)) | (F.size(given) == 0) | F.array_contains(given, "")
    message = F.concat(F.concat(F.get(stamps, F.lit(0)), F.lit(".")).cast("binary"), F.col(payload).cast("binary"))
    known = F.arrays_overlap(given, F.array(*[hmac_sha256(s, message) for s in secrets])) if secrets and all(secrets) else F.lit(False)
    late = F.abs(F.col(now) - F.get(stamps, F.lit(0)).try_cast("bigint")) > (tolerance if tolerance > 0 else TOLERANCE)
    return df.withColumn("signature_error", F.when(odd, MALFORMED).when(~F.coalesce(known, F.lit(False)), UNSIGNED).when(late, STALE))

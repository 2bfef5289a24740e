"""The fixed list of fields that rules and models can read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import ByteType, DoubleType, LongType, StringType, StructField, StructType

NUMBER, STRING = "number", "string"

#: Length in seconds of each trailing window, by the name that fields carry.
WINDOWS = {"1h": 3_600, "24h": 86_400, "7d": 604_800}
ENTITIES = ("card", "uid", "device", "email")
#: Entities for which the distinct cards of a day are counted.
SHARED = ("device", "email")
DAY = 86_400
#: A key that was idle so long counts as never seen.
IDLE_TTL = 30 * DAY


@dataclass(frozen=True)
class Field:
    name: str
    kind: str


def _fields() -> tuple[Field, ...]:
    strings = ("product_code", "card_network", "card_type", "purchaser_email_domain", "recipient_email_domain", "device_type", "device_info")
    numbers = ("distance", "billing_region", "billing_country_code")
    out = [Field("amount", NUMBER), *(Field(s, STRING) for s in strings), *(Field(n, NUMBER) for n in numbers)]
    for entity in ENTITIES:
        for window in WINDOWS:
            out += [Field(f"{entity}_txn_count_{window}", NUMBER), Field(f"{entity}_amount_sum_{window}", NUMBER)]
        out += [Field(f"{entity}_{x}", NUMBER) for x in ("mean_amount_7d", "amount_ratio_7d", "seconds_since_first", "seconds_since_last")]
    out += [Field(f"distinct_cards_per_{e}_24h", NUMBER) for e in SHARED]
    return (*out, Field("risk_score", NUMBER))


FIELDS = _fields()
KIND_OF = {f.name: f.kind for f in FIELDS}
RAW = tuple(f.name for f in FIELDS[:11])
FEATURES = tuple(f.name for f in FIELDS[11:-1])

#: Columns beside the fields in a feature table; a null label_time means never.
META = StructType([
    StructField("id", LongType(), False),
    StructField("dt", LongType(), False),
    StructField("fraud", ByteType(), False),
    StructField("label_time", LongType()),
])


def struct(fields: tuple[Field, ...] = FIELDS) -> StructType:
    return StructType([StructField(f.name, DoubleType() if f.kind == NUMBER else StringType()) for f in fields])


def table_struct() -> StructType:
    return StructType([*META, *struct()])

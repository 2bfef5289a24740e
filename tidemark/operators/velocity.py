"""Velocity: what a key did before each payment, as of just before it.

For a payment at (dt, id) and a window of w seconds the payments that count
are those of its key at an earlier (dt, id) and later than dt - w. One frame
can't say that, but the difference of two that only grow can, and growing
frames cost one step per row:

    rows before (dt, id)  -  rows up to dt - w

Distinct cards are counted the same way, by how many cards have entered the
window and how many have left it. All columns of one entity come from a single
exchange on its key.

A key with a large share of all rows makes one long task that way, so such keys
are counted first and summed by key and bucket, a minute or so of time. A payment
enters at its own time and leaves each window at a time of its own, both in the
bucket that holds that time. Totals of buckets are scanned once a key, which
costs a row per bucket, and a payment's figures are the totals of the buckets
before its own and the running sums within it. So no task holds more of a
key than a bucket, however many payments it has in an hour or a week.

Payments not yet seen (probes) go through the same frames beside the history,
with a weight of 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import DAY, ENTITIES, FIELDS, IDLE_TTL, SHARED, WINDOWS
from tidemark.functions.values import divide, milli, number
from tidemark.scratch import scratch_dir, stored

#: Width of the ring buckets that stand for each window's payments.
BUCKETS = {"1h": 60, "24h": 900, "7d": 3_600}
#: Rows without a key are nobody's history; they are spread over so many groups.
KEYLESS_GROUPS = 1_024
#: A key is hot if it has more rows than a task sorts with ease, and than one in HOT_PARTS of all.
HOT_ROWS, HOT_PARTS = 250_000, 100_000
#: Seconds of time in which a hot key's payments are taken one by one.
CHUNK = 60
#: Rows in time, a probe (whose _real is 0) before a payment at its own place.
_ORDER = ("dt", "id", "_real")


def _finite(x: Column) -> Column:
    x = number(x)
    return F.when((x != float("inf")) & (x != float("-inf")), x + 0.0)


def keys(entity: str) -> list[Column]:
    """The columns that name an instance of the entity; all null if there is none."""
    card = _finite(F.col("card1"))
    if entity == "card":
        return [card]
    if entity == "uid":
        region, d1 = _finite(F.col("billing_region")), _finite(F.col("d1"))
        begun = F.floor(F.col("dt") / DAY).cast("double") - d1
        all_ = card.isNotNull() & region.isNotNull() & begun.isNotNull()
        return [F.when(all_, x) for x in (card, region, begun)]
    return [F.col({"device": "device_info", "email": "purchaser_email_domain"}[entity])]


def keyed(payments: DataFrame, entity: str) -> tuple[DataFrame, list[str]]:
    """payments with the entity's key columns, and the columns to partition by."""
    names = [f"_k{i}" for i in range(len(keys(entity)))]
    spread = F.when(F.col("_k0").isNull(), F.pmod(F.xxhash64("id"), F.lit(KEYLESS_GROUPS)))
    return payments.withColumns(dict(zip(names, keys(entity), strict=True))).withColumn("_ks", spread), [*names, "_ks"]


def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def hot_keys(payments: DataFrame, entity: str, rows: int = HOT_ROWS) -> DataFrame | None:
    """The entity's hot keys in these payments, HOT_PARTS at most, or None if there are none."""
    df, by = keyed(payments, entity)
    counts = df.filter("_k0 IS NOT NULL").groupBy(*by[:-1]).agg(F.count("*").alias("_n"))
    counts = stored(counts.filter(F.col("_n") > rows), scratch_dir(payments.sparkSession), "counts")
    if counts.isEmpty():
        return None
    # fewer than HOT_PARTS keys, as each has more than that part of all, or of the payments of all keys that have many
    total = counts.agg(F.sum("_n")).first()[0]
    hot = counts.filter(F.col("_n") > total // HOT_PARTS).drop("_n")
    return None if hot.isEmpty() else hot


def entity_features(payments: DataFrame, entity: str, windows: Sequence[str] = tuple(WINDOWS), buckets: dict[str, int] | None = None, chunk: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """payments (with _milli, and _real: 0 for probes, else 1) and the entity's exact features; with buckets, those of ring buckets.

    chunk: sum rows by key and so many seconds of time; hot: those of these keys only.
    A day at most, and a part of the day's ring buckets. Without windows, recency alone.

    A payment without key has none of them. A key not seen within IDLE_TTL has
    counts and sums of zero and no mean, ratio or recency.
    """
    df, by = keyed(payments, entity)
    if not chunk:
        df = _in_frames(df, entity, by, windows, buckets)
    else:
        if chunk > DAY or (buckets and buckets["24h"] % chunk):
            raise ValueError("a chunk is a day at most, and a part of the day's ring buckets")
        if hot is None:
            df = df.withColumn("_hot", F.col("_k0").isNotNull())
        else:
            df = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), by[:-1], "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
        df = stored(df, scratch_dir(df.sparkSession), entity)
        split = _in_chunks(df.filter("_hot"), entity, by[:-1], windows, buckets, chunk)
        df = _in_frames(df.filter("NOT _hot"), entity, by, windows, buckets).unionByName(split).drop("_hot")
    return _with_features(df, entity, by, windows)


def _with_features(df: DataFrame, entity: str, by: list[str], windows: Sequence[str]) -> DataFrame:
    """df with the entity's features by their names, from what _in_frames adds."""
    has = F.col("_k0").isNotNull()
    out: dict[str, Column] = {}
    for w in windows:
        out[f"{entity}_txn_count_{w}"] = F.when(has, F.col(f"_n{w}").cast("double"))
        out[f"{entity}_amount_sum_{w}"] = F.when(has, F.col(f"_s{w}") / 1000.0)
    df = _add(df, out)
    if "7d" in windows:
        mean = divide(F.col(f"{entity}_amount_sum_7d"), F.col(f"{entity}_txn_count_7d"))
        df = df.withColumn(f"{entity}_mean_amount_7d", mean)
        mean = F.col(f"{entity}_mean_amount_7d")
        df = df.withColumn(f"{entity}_amount_ratio_7d", F.when(mean > 0, divide(F.col("amount"), mean)))
    seen = has & F.col("_gap").isNotNull()
    df = _add(df, {
        f"{entity}_seconds_since_first": F.when(seen, (F.col("dt") - F.col("_began")).cast("double")),
        f"{entity}_seconds_since_last": F.when(seen, F.col("_gap").cast("double")),
    })
    if entity in SHARED and windows:
        df = df.withColumn(f"distinct_cards_per_{entity}_24h", F.when(has, F.col("_cards").cast("double")))
    return df.drop(*by, "_began", "_gap", "_cards", *[f"_{x}{w}" for w in windows for x in "ns"])


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def _leaves(seconds: int, bucket: int | None) -> Column:
    """When a payment at dt is out of a window, of ring buckets if their width is given."""
    return F.col("dt") + seconds if bucket is None else (F.floor(F.col("dt") / bucket).cast("bigint") + seconds // bucket + 1) * bucket


def _in_frames(df: DataFrame, entity: str, by: list[str], windows: Sequence[str], buckets: dict[str, int] | None) -> DataFrame:
    """df with _n<w> and _s<w> (payments and thousandths in each window), _gap, _began and _cards, by frames over a key's rows."""
    before = W.partitionBy(*by).orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1)
    real = F.col("_real") == 1
    gap = F.col("dt") - F.max(F.when(real, F.col("dt"))).over(before)
    df = _add(df, {"_n": _zero(F.sum("_real").over(before)), "_s": _zero(F.sum("_milli").over(before)), "_gap": F.when(gap < IDLE_TTL, gap)})
    df = _add(df, {"_began": F.max(F.when(real & F.col("_gap").isNull(), F.col("dt"))).over(before)})
    if buckets is None:
        gone = {w: W.partitionBy(*by).orderBy("dt").rangeBetween(W.unboundedPreceding, -WINDOWS[w]) for w in windows}
    else:
        df = _add(df, {f"_b_{w}": F.floor(F.col("dt") / buckets[w]).cast("bigint") for w in windows})
        gone = {w: W.partitionBy(*by).orderBy(f"_b_{w}").rangeBetween(W.unboundedPreceding, -(WINDOWS[w] // buckets[w] + 1)) for w in windows}
    df = _add(df, {f"{x}{w}": F.col(x) - _zero(F.sum(y).over(gone[w])) for w in windows for x, y in (("_n", "_real"), ("_s", "_milli"))})
    if entity in SHARED and windows:
        df = _distinct(df, by, None if buckets is None else buckets["24h"])
    return df.drop("_n", "_s", *[f"_b_{w}" for w in windows])


def _distinct(df: DataFrame, by: list[str], bucket: int | None) -> DataFrame:
    """_cards: distinct cards of the last day, entries into the window before this row less exits up to its far end."""
    place, length = ("dt", DAY) if bucket is None else ("_place", DAY // bucket + 1)
    if bucket is not None:
        df = df.withColumn("_place", F.floor(F.col("dt") / bucket).cast("bigint"))
    df = df.withColumn("_card", _finite(F.col("card1")))
    # an exchange on the key serves groups of key and card too; probes are a group of their own
    same = W.partitionBy(*by, "_card", "_real").orderBy("dt", "id")
    last, following = F.lag(place).over(same), F.lead(place).over(same)
    counts = F.col("_card").isNotNull() & (F.col("_real") == 1)
    enters = counts & (last.isNull() | (F.col(place) - last >= length))
    leaves = counts & (following.isNull() | (following - F.col(place) >= length))
    df = _add(df, {"_enters": enters.cast("bigint"), "_leaves": leaves.cast("bigint")})
    inside = F.sum("_enters").over(W.partitionBy(*by).orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1))
    outside = F.sum("_leaves").over(W.partitionBy(*by).orderBy(place).rangeBetween(W.unboundedPreceding, -length))
    return df.withColumn("_cards", _zero(inside) - _zero(outside)).drop("_card", "_enters", "_leaves", "_place")


#: What happens to a key, in the order in which it counts at one time: payments and cards leave, then a probe or a payment comes, then its card counts.
_PROBE, _PAYMENT, _CARD = 0, 1, 2


def _in_chunks(df: DataFrame, entity: str, by: list[str], windows: Sequence[str], buckets: dict[str, int] | None, chunk: int) -> DataFrame:
    """What _in_frames gives, for rows that all have a key, by totals per key and chunk of time and running sums within a chunk.

    Nothing but the totals, one row per key and chunk, is ever gathered by key.
    """
    shared = entity in SHARED and bool(windows)
    out_of = {w: f"left_{w}" for w in windows}
    kinds = {name: -1 - i for i, name in enumerate([*out_of.values(), "card_left"])}
    event = lambda t, kind, id_=None: F.struct(t.cast("bigint").alias("_t"), F.lit(kind).alias("_kind"), (F.lit(None) if id_ is None else id_).cast("bigint").alias("_id"), (F.col("_milli") if kind < 0 and kind != kinds["card_left"] else F.lit(0)).cast("bigint").alias("_m"))
    own = df.select(*by, F.col("dt").alias("_t"), F.when(F.col("_real") == 1, _PAYMENT).otherwise(_PROBE).alias("_kind"), F.col("id").alias("_id"), F.col("_milli").alias("_m"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    events = own
    if windows:
        exits = df.filter("_real = 1").select(*by, F.inline(F.array(*[event(_leaves(WINDOWS[w], buckets and buckets[w]), kinds[out_of[w]]) for w in windows])))
        events = own.unionByName(exits, allowMissingColumns=True)
    if shared:
        events = events.unionByName(_card_events(df, by, chunk, buckets and buckets["24h"], lambda t, kind, id_=None: event(t, kinds.get(kind, _CARD), id_)), allowMissingColumns=True)
    events = events.withColumn("_c", F.floor(F.col("_t") / chunk).cast("bigint"))
    paid = F.col("_kind") == _PAYMENT
    of = lambda kind, x: F.sum(F.when(F.col("_kind") == kind, x))
    sums = {"n_in": of(_PAYMENT, 1), "s_in": of(_PAYMENT, F.col("_m")), **{f"n_{k}": of(kinds[k], 1) for k in out_of.values()}, **{f"s_{k}": of(kinds[k], F.col("_m")) for k in out_of.values()}}
    if shared:
        sums |= {"cards_in": of(_CARD, 1), "cards_out": of(kinds["card_left"], 1)}
    totals = events.groupBy(*by, "_c").agg(*[x.alias(k) for k, x in sums.items()], F.min(F.when(paid, F.col("_t"))).alias("_low"), F.max(F.when(paid, F.col("_t"))).alias("_high"))
    in_time = W.partitionBy(*by).orderBy("_c")
    earlier = in_time.rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.last("_high", ignorenulls=True).over(earlier))
    # no gap of IDLE_TTL fits into a chunk, so a history begins with a chunk's first payment or not in it
    totals = totals.withColumn("_begins", F.when(F.col("_before").isNull() | (F.col("_low") - F.col("_before") >= IDLE_TTL), F.col("_low")))
    held = totals.select(*by, "_c", *[_zero(F.sum(k).over(earlier)).alias(f"b_{k}") for k in sums], "_before", F.max("_begins").over(in_time.rowsBetween(W.unboundedPreceding, 0)).alias("_start"), F.max("_begins").over(earlier).alias("_first"))
    events = events.join(held, [*by, "_c"])
    # what leaves at a time is out of the window of what comes at that time
    here = W.partitionBy(*by, "_c").orderBy("_t", F.col("_kind") >= 0, "_id", "_kind").rowsBetween(W.unboundedPreceding, -1)
    run = {k: F.col(f"b_{k}") + _zero(x.over(here)) for k, x in sums.items()}
    last = F.coalesce(F.max(F.when(paid, F.col("_t"))).over(here), F.col("_before"))
    # a probe may come before the payment with which a new history begins in its chunk
    began = F.coalesce(F.when(F.col("_start") <= F.col("_t"), F.col("_start")), F.col("_first"))
    figures = {f"_n{w}": run["n_in"] - run[f"n_left_{w}"] for w in windows} | {f"_s{w}": run["s_in"] - run[f"s_left_{w}"] for w in windows}
    figures |= {"_gap": F.col("_t") - last, "_began": began} | ({"_cards": run["cards_in"] - run["cards_out"]} if shared else {})
    done = events.select("_kind", "_row", *[x.alias(k) for k, x in figures.items()]).filter((F.col("_kind") == _PROBE) | paid)
    return done.select("_row.*", *figures).withColumn("_gap", F.when(F.col("_gap") < IDLE_TTL, F.col("_gap")))


def _card_events(df: DataFrame, by: list[str], chunk: int, bucket: int | None, event) -> DataFrame:
    """When cards come into a key's last day and when they leave it.

    A card that comes twice in a chunk hasn't left in between, so the first and last payment of each card and chunk say it.
    """
    place, length = (lambda t: t, DAY) if bucket is None else (lambda t: F.floor(t / bucket).cast("bigint"), DAY // bucket + 1)
    cards = df.filter("_real = 1").withColumn("_card", _finite(F.col("card1"))).filter("_card IS NOT NULL")
    cards = cards.groupBy(*by, "_card", F.floor(F.col("dt") / chunk).cast("bigint").alias("_c")).agg(F.min(F.struct("dt", "id")).alias("_in"), F.max("dt").alias("dt"))
    same = W.partitionBy(*by, "_card").orderBy("_c")
    cards = _add(cards, {"_last": F.lag("dt").over(same), "_next": F.lead("_in.dt").over(same), "_milli": F.lit(0)})
    enters = F.col("_last").isNull() | (place(F.col("_in.dt")) - place(F.col("_last")) >= length)
    leaves = F.col("_next").isNull() | (place(F.col("_next")) - place(F.col("dt")) >= length)
    both = F.array(F.when(enters, event(F.col("_in.dt"), "card", F.col("_in.id"))), F.when(leaves, event(_leaves(DAY, bucket), "card_left")))
    return cards.select(*by, F.inline(F.filter(both, lambda x: x.isNotNull())))


def features(payments: DataFrame, entities: Sequence[str] = ENTITIES, buckets: dict[str, int] | None = None, chunks: Mapping[str, int] | None = None, hot: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """payments with all velocity features: exact ones, or with buckets those of ring buckets.

    chunks: seconds of time by which an entity's rows are summed; hot: for the rows of these keys only.
    """
    df = payments.withColumns({"_milli": milli(F.col("amount")), "_real": F.lit(1).cast("bigint")})
    return _all_features(df, entities, buckets, chunks, hot)


def _all_features(df: DataFrame, entities: Sequence[str], buckets: dict[str, int] | None, chunks: Mapping[str, int] | None, hot: Mapping[str, DataFrame] | None) -> DataFrame:
    for entity in entities:
        df = entity_features(df, entity, buckets=buckets, chunk=(chunks or {}).get(entity), hot=(hot or {}).get(entity))
    return df.drop("_milli", "_real")


def hot_chunks(payments: DataFrame, rows: int = HOT_ROWS, chunk: int = CHUNK) -> dict:
    """chunks and hot, for features, of the entities that have hot keys in these payments."""
    hot = {e: h for e in ENTITIES if (h := hot_keys(payments, e, rows)) is not None}
    return {"chunks": dict.fromkeys(hot, chunk), "hot": hot}


def as_of(history: DataFrame, probes: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """All features of probes as if each came at its (dt, id), without any of them counting for another.

    A payment of history at a probe's own (dt, id) doesn't count for it, so payments can be probed against themselves.
    Keys with over `rows` rows in both are summed by chunks of time.
    """
    real = lambda df, n: df.withColumn("_real", F.lit(n).cast("bigint"))
    df = real(history, 1).unionByName(real(probes, 0), allowMissingColumns=True)
    split = hot_chunks(df, rows)
    df = df.withColumns({"_probe": F.col("_real") == 0, "_milli": F.when(F.col("_real") == 1, milli(F.col("amount"))).otherwise(0)})
    return _all_features(df, ENTITIES, None, **split).filter("_probe").drop("_probe")


def features_by_arrival(payments: DataFrame, arrival: Sequence[str], entities: Sequence[str] = ENTITIES) -> DataFrame:
    """payments with all features as a pipeline gives them that takes each payment when it arrives, late ones too.

    arrival: the columns that say in which order payments arrive. Nothing that
    was said before is taken back, so a payment that comes after later ones of
    its key counts, for that key, as if it came with the latest of them: at the
    running maximum of time in order of arrival.
    """
    real = payments.withColumns({"_milli": milli(F.col("amount")), "_real": F.lit(1).cast("bigint"), "_dt": F.col("dt"), "_id": F.col("id"), "_arrival": F.struct(*arrival)})
    for entity in entities:
        df, by = keyed(real, entity)
        latest = F.max("_dt").over(W.partitionBy(*by).orderBy("_arrival").rowsBetween(W.unboundedPreceding, 0))
        real = _with_features(_in_frames(df.withColumns({"dt": latest, "id": F.col("_arrival")}), entity, by, tuple(WINDOWS), None), entity, by, tuple(WINDOWS))
        real = real.withColumns({"dt": F.col("_dt"), "id": F.col("_id")})
    return real.drop("_milli", "_real", "_dt", "_id", "_arrival")


def feature_table(payments: DataFrame, score: Column | None = None, rows: int = HOT_ROWS) -> DataFrame:
    """The catalog's fields beside id, dt, fraud and label_time (null: never labelled).

    Keys are counted first, and those with over `rows` rows summed by chunks of time.
    """
    df = features(payments, **hot_chunks(payments, rows))
    label_time = F.col("label_time").cast("bigint") if "label_time" in payments.columns else F.lit(None).cast("bigint")
    df = df.withColumn("risk_score", score if score is not None else F.lit(None).cast("double"))
    return df.select("id", "dt", F.col("is_fraud").alias("fraud"), label_time.alias("label_time"), *[f.name for f in FIELDS])

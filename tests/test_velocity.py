from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import DAY, ENTITIES, FEATURES, FIELDS, IDLE_TTL, WINDOWS
from tidemark.operators import sketches, velocity
from tidemark.sources.payments import COLUMNS

SCHEMA = "id bigint, dt bigint, amount double, product_code string, card1 double, card_network string, card_type string, billing_region double, billing_country_code double, distance double, purchaser_email_domain string, recipient_email_domain string, d1 double, device_type string, device_info string, is_fraud tinyint"


def payment(id_, dt, amount=10.0, card=1.0, region=1.0, d1=0.0, device="d", email="e.com"):
    return (id_, dt, amount, "W", card, "visa", "debit", region, 87.0, None, email, None, d1, "mobile", device, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def history(n=260, seed=3):
    rng = random.Random(seed)
    out, dt = [], -5000
    for i in range(n):
        dt += rng.choice([0, 0, 1, 59, 60, 600, 3599, 3600, 3601, 20000, 86400, 86399, 300000, IDLE_TTL // 4])
        out.append(payment(rng.randint(0, 10**6) * 1000 + i, dt, rng.choice([None, 0.0005, 1.5, 20.123, 99.9995]), rng.choice([None, 1.0, 2.0, 3.0, -0.0, float("nan")]), rng.choice([1.0, None]), rng.choice([0.0, 3.0]), rng.choice([None, "a", "b"]), rng.choice(["x.com", "y.com", None])))
    rng.shuffle(out)
    return out


def key(row, entity):
    card, region, d1, device, email = row[4], row[7], row[12], row[14], row[10]
    card = None if card is None or card != card else card + 0.0
    if entity == "card":
        return card
    if entity == "uid":
        return None if None in (card, region, d1) else (card, region, row[1] // 86400 - d1)
    return device if entity == "device" else email


def milli(x):
    return 0 if x is None else int(abs(x) * 1000 + 0.5)


def brute(rows, buckets=None):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    out = {}
    for i, r in enumerate(rows):
        f = {}
        for e in ENTITIES:
            k = key(r, e)
            names = [n for n in FEATURES if n.startswith(f"{e}_") or n == f"distinct_cards_per_{e}_24h"]
            if k is None:
                f |= dict.fromkeys(names)
                continue
            past = [p for p in rows[:i] if key(p, e) == k]
            inside = {}
            for w, s in WINDOWS.items():
                b = (buckets or {}).get(w)
                inside[w] = [p for p in past if (p[1] > r[1] - s if b is None else p[1] // b >= r[1] // b - s // b)]
                f[f"{e}_txn_count_{w}"], f[f"{e}_amount_sum_{w}"] = float(len(inside[w])), sum(milli(p[2]) for p in inside[w]) / 1000
            n, s = f[f"{e}_txn_count_7d"], f[f"{e}_amount_sum_7d"]
            mean = s / n if n else None
            f[f"{e}_mean_amount_7d"], f[f"{e}_amount_ratio_7d"] = mean, (r[2] / mean if mean and r[2] is not None else None)
            session, last = [], None
            for p in past:
                session = [] if last is not None and p[1] - last >= IDLE_TTL else session
                session.append(p[1])
                last = p[1]
            seen = bool(session) and r[1] - session[-1] < IDLE_TTL
            f[f"{e}_seconds_since_first"] = float(r[1] - session[0]) if seen else None
            f[f"{e}_seconds_since_last"] = float(r[1] - session[-1]) if seen else None
            if e in ("device", "email"):
                f[f"distinct_cards_per_{e}_24h"] = float(len({key(p, "card") for p in inside["24h"]} - {None}))
        out[r[0]] = f
    return out


def check(df, want):
    for r in df.collect():
        for c, v in want[r.id].items():
            got = r[c]
            assert got == v or (got is not None and v is not None and abs(got - v) < 1e-9 * max(1, abs(v))), (r.id, c, got, v)


def test_exact_and_ring_against_brute_force(spark):
    rows = history()
    df = frame(spark, rows).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    check(velocity.features(df), brute(rows))
    check(velocity.features(df, buckets=velocity.BUCKETS), brute(rows, velocity.BUCKETS))


@pytest.mark.parametrize("chunk", [60, 900, DAY])
def test_chunks_of_time_change_nothing(spark, chunk):
    rows = history(240, 21)
    df = frame(spark, rows).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    check(velocity.features(df, chunks=dict.fromkeys(ENTITIES, chunk)), brute(rows))
    if chunk <= velocity.BUCKETS["24h"]:
        check(velocity.features(df, buckets=velocity.BUCKETS, chunks=dict.fromkeys(ENTITIES, chunk)), brute(rows, velocity.BUCKETS))


@pytest.mark.parametrize(("chunk", "buckets"), [(DAY + 1, None), (1_000, velocity.BUCKETS)])
def test_chunks_that_do_not_fit(spark, chunk, buckets):
    with pytest.raises(ValueError):
        velocity.features(frame(spark, history(5)), chunks={"card": chunk}, buckets=buckets)


def test_a_key_that_is_hot_in_one_hour(spark):
    """Nearly all rows are of one key, many at the same second, and no task has many of them."""
    rng = random.Random(3)
    rows = [payment(i, 500_000 + rng.randint(0, 3_600 if i % 3 else 600_000), card=float(rng.randint(0, 5))) for i in range(400)]
    check(velocity.features(frame(spark, rows), **velocity.hot_chunks(frame(spark, rows), 50)), brute(rows))
    wide = [payment(i, 500_000 + i % 3_600, card=1.0) for i in range(40_000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or it puts small partitions together
    try:
        df = velocity.features(frame(spark, wide).repartition(4), ("card",), chunks={"card": 60}).select("id", F.spark_partition_id().alias("part"))
        sizes = sorted(r["count"] for r in df.groupBy("part").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and sum(sizes) == 40_000 and sizes[-1] < 2 * sum(sizes) / len(sizes)


def test_sketches_keep_rows_whose_ids_come_again(spark):
    rows = history(50, 3)
    again = [*rows, *[(r[0], r[1] + 100, *r[2:]) for r in rows], *rows[:4]]
    assert sketches.features(frame(spark, again)).count() == len(again)


@pytest.mark.parametrize("rows_", [2, 30])
def test_hot_keys_are_dealt_by_time_and_nothing_changes(spark, rows_):
    rows = history(240, 5)
    df = frame(spark, rows).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    split = velocity.hot_chunks(df, rows_)
    assert split["hot"] and set(split["hot"]) == set(split["chunks"])
    check(velocity.features(df, **split), brute(rows))
    check(velocity.feature_table(df, rows=rows_), brute(rows))
    probes, past = rows[:60], rows[60:]
    cut = lambda x: frame(spark, x).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    check(velocity.as_of(cut(past), cut(probes), rows=rows_), {p[0]: brute([*past, p])[p[0]] for p in probes})
    check(velocity.as_of(df, df, rows=rows_), brute(rows))


def test_a_probe_before_a_new_history_belongs_to_the_old_one(spark):
    day = 86_400
    past = [payment(i, t) for i, t in enumerate([0, 10 * day, 41 * day])]
    probes = [payment(100 + i, t) for i, t in enumerate([39 * day, 40 * day - 1, 40 * day, 41 * day + 1])]
    for n in (1, 10**9):
        got = velocity.as_of(frame(spark, past), frame(spark, probes), rows=n)
        check(got, {p[0]: brute([*past, p])[p[0]] for p in probes})


def test_window_edges_ties_and_ttl(spark):
    rows = [payment(5, 100_000), payment(3, 100_000), payment(4, 100_000), payment(6, 103_599), payment(7, 103_600), payment(8, 103_600 + IDLE_TTL - 1), payment(9, 103_600 + 2 * IDLE_TTL - 1)]
    got = {r.id: r for r in velocity.features(frame(spark, rows), ("card",)).collect()}
    assert [got[i].card_txn_count_1h for i in (3, 4, 5, 6, 7)] == [0, 1, 2, 3, 1]
    assert got[8].card_seconds_since_last == IDLE_TTL - 1 and got[9].card_seconds_since_last is None and got[9].card_txn_count_7d == 0


def test_no_payment_sees_the_future(spark):
    rows = history(150, 8)
    cut = sorted(r[1] for r in rows)[90]
    past = [r for r in rows if r[1] < cut]
    other = [payment(10**10 + i, cut + i, 5.0, 2.0) for i in range(40)]
    a = {r.id: r.asDict() for r in velocity.features(frame(spark, rows)).filter(F.col("dt") < cut).collect()}
    b = {r.id: r.asDict() for r in velocity.features(frame(spark, past + other)).filter(F.col("dt") < cut).collect()}
    assert {k: str(v) for k, v in a.items()} == {k: str(v) for k, v in b.items()}


def test_probes_do_not_count(spark):
    rows = history(120, 4)
    probes, past = rows[:15], rows[15:]
    df = lambda x: frame(spark, x).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    got = velocity.as_of(df(past), df(probes))
    for p in probes:
        want = brute([*past, p])[p[0]]
        check(got.filter(F.col("id") == p[0]), {p[0]: {k: v for k, v in want.items() if not k.startswith("distinct")}})


@pytest.mark.parametrize("seed", [4, 31])
def test_probes_have_distinct_cards(spark, seed):
    rows = history(160, seed)
    probes, past = rows[:25], rows[25:]
    df = lambda x: frame(spark, x).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    got = velocity.as_of(df(past), df(probes)).drop("is_fraud").collect()
    assert len(got) == len(probes) and set(FEATURES) <= set(got[0].asDict())
    want = {p[0]: brute([*past, p])[p[0]] for p in probes}
    assert any(w["distinct_cards_per_device_24h"] for w in want.values())
    for r in got:
        assert {c: r[c] for c in FEATURES if c.startswith("distinct")} == {c: v for c, v in want[r.id].items() if c.startswith("distinct")}
    check(velocity.as_of(df(past), df(probes)), want)


def test_payments_probed_against_themselves(spark):
    rows = history(200, 12)
    df = frame(spark, rows).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    check(velocity.as_of(df, df), brute(rows))


def test_sketches_never_fall_short(spark):
    rows = history(200, 9)
    df = frame(spark, rows).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    for buckets in (sketches.SKETCH_BUCKETS, velocity.BUCKETS):
        ring = {r.id: r for r in velocity.features(df, ("card",), buckets=buckets).filter("card1 IS NOT NULL").collect()}
        for width, equal in ((2, False), (1 << 14, True)):
            got = sketches.count_min(df, "card", width=width, buckets=buckets).collect()
            assert {r.id for r in got} == set(ring)
            for r in got:
                for name in (f"card_{x}_{w}" for w in WINDOWS for x in ("txn_count", "amount_sum")):
                    assert r[name] == ring[r.id][name] if equal else r[name] >= ring[r.id][name]


def test_sketched_features_by_ring_buckets(spark):
    rows = history(150, 4)
    df = frame(spark, rows).withColumn("card1", F.nanvl("card1", F.lit(None).cast("double")))
    ring = {r.id: r for r in velocity.features(df, buckets=sketches.SKETCH_BUCKETS).collect()}
    for hot_rows in (velocity.HOT_ROWS, 5):
        got = sketches.features(df, rows=hot_rows).collect()
        assert len(got) == len(rows) and set(got[0].asDict()) == set(ring[got[0].id].asDict())
        for r in got:
            for name in FEATURES:
                a, b = r[name], ring[r.id][name]
                assert (a is None) == (b is None), name
                # few keys and cards: no cell is shared, and bitmaps are nearly empty
                assert b is None or abs(a - b) <= (0.01 if name.startswith("distinct") else 1e-9 * abs(b)), (name, a, b)


@pytest.mark.parametrize("width", [1, 1 << 10])
def test_bitmaps_by_counting_bits(spark, width):
    rng = random.Random(6)
    rows = [payment(i, rng.randint(0, 60) * 1_800 + rng.randint(0, 2), card=rng.choice([None, *map(float, range(40))]), device=rng.choice(["a", "b", None])) for i in range(300)]
    bits = {c: int(hashlib.md5(f"b|{int(c * 1000)}".encode()).hexdigest()[:8], 16) % 16 for c in map(float, range(40))}
    cell = lambda row, key: int(hashlib.md5(f"d|{row}|{key}".encode()).hexdigest()[:8], 16) % width
    for r in sketches.distinct_cards(frame(spark, rows), "device", rows=2, width=width, bits=16).collect():
        me = rows[r.id]
        held = []
        for row in (0, 1):
            near = [x for x in rows if x[14] and cell(row, x[14]) == cell(row, me[14]) and me[1] // 3_600 - 24 <= x[1] // 3_600 and (x[1], x[0]) < (me[1], me[0])]
            held.append(len({bits[x[4]] for x in near if x[4] is not None}))
        assert r.distinct_cards_per_device_24h == pytest.approx(-16 * math.log(1 - min(min(held), 15) / 16), abs=1e-3)


def test_distinct_sketch(spark):
    rows = [payment(i, 7_200 + i, card=float(i % 50)) for i in range(100)] + [payment(1000, 11_000, card=7.0), payment(1001, 7_200 + 30 * 3_600)]
    got = {r.hour: r.cards for r in sketches.distinct_by_hour(frame(spark, rows), "device").collect()}
    assert got[2] == 0 and abs(got[3] - 50) <= 3 and got[32] == 0


@pytest.mark.parametrize("empty", [True, False])
def test_empty_and_keyless(spark, empty):
    rows = [] if empty else [payment(1, 5, None, None, None, None, None, None)]
    got = velocity.feature_table(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(v is None for r in got for v in r[15:])
    assert len(FIELDS) == 54 and set(COLUMNS) == set(frame(spark, []).columns)


def test_one_exchange_per_entity(spark):
    plan = velocity.features(frame(spark, history(20)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4


def test_sketches_of_nothing(spark):
    assert sketches.features(frame(spark, [])).collect() == []
    got = sketches.features(frame(spark, [payment(1, 5, None, None, None, None, None, None)])).first()
    assert all(got[name] is None for name in FEATURES)

from __future__ import annotations

import hashlib
import json
import os
import pickle
import random

import pytest
from pyspark.sql import functions as F
from test_velocity import SCHEMA, frame
from test_velocity import history as payments_of

from tidemark.operators import labels, ruleset, velocity
from tidemark.operators.ruleset import RuleSet
from tidemark.sources import records
from tidemark.streaming import keyed
from tidemark.streaming import pipeline as st

FEATURE = [f"{e}_{x}" for e in ("card", "uid", "device", "email") for x in ("txn_count_1h", "txn_count_7d", "amount_sum_24h", "mean_amount_7d", "amount_ratio_7d", "seconds_since_first", "seconds_since_last")] + ["distinct_cards_per_device_24h", "distinct_cards_per_email_24h"]


def rows_of(n=70, seed=6):
    out = []
    for r in payments_of(n, seed):
        card = None if r[4] is None or r[4] != r[4] else r[4]
        # times after the Unix epoch's own zero, close together, so that one delay spans some of them
        out.append((*r[:4], card, *r[5:]))
    return sorted(out, key=lambda r: (r[1], r[0]))


def feed(tmp_path, batches):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    names = SCHEMA.replace(",", "").split()[0::2]
    for i, b in enumerate(batches):
        n = len(list(folder.iterdir()))
        file = folder / f"b{n:03}-{i}.json"
        file.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in b))
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # batches are taken by the files' times
    return str(folder)


def heartbeat(dt):
    return (None, dt, *[None] * 14)


@pytest.fixture(autouse=True)
def store(spark):
    st.configure(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").json(folder)


def finish(q):
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()


def same(spark, out, rows):
    got = {r.id: r for r in spark.read.schema("id bigint, " + ", ".join(f"{c} double" for c in FEATURE)).json(out).collect()}
    want = {r.id: r for r in velocity.features(frame(spark, rows)).select("id", *FEATURE).collect()}
    assert set(got) == set(want)
    for i, r in want.items():
        for c in FEATURE:
            assert got[i][c] == r[c] or abs(got[i][c] - r[c]) < 1e-9 * max(1, abs(r[c])), (i, c, got[i][c], r[c])


def test_stream_gives_what_a_batch_gives_after_a_restart(spark, tmp_path):
    rows = rows_of()
    rng = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[1] + rng.randint(0, 3 * 86_400))
    end = heartbeat(rows[-1][1] + 20 * 86_400)
    folder = feed(tmp_path, [mixed[:30], mixed[30:]])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    keep = lambda df: df.select("id", "late", *FEATURE)
    finish(st.start(st.live_features(stream(spark, folder), "5 days", 3), out, check, keep))
    feed(tmp_path, [[end], [heartbeat(end[1] + 1)]])
    finish(st.start(st.live_features(stream(spark, folder), "5 days", 3), out, check, keep))
    same(spark, out, rows)
    assert spark.read.json(out).filter("late").count() == 0
    kept = {r.entity: r["keys"] for r in st.state_summary(spark, check).collect()}
    past = rows[-1][1] + 20 * 86_400 - keyed.IDLE_TTL - 5 * 86_400
    assert "waiting" not in kept and kept["email"] == len({r[10] for r in rows if r[10] and r[1] > past})


def test_a_stream_goes_on_from_a_batch(spark, tmp_path):
    rows = rows_of(90, 11)
    folder = feed(tmp_path, [rows[50:70], rows[70:], [heartbeat(rows[-1][1] + 86_400)], [heartbeat(rows[-1][1] + 86_401)]])
    out = str(tmp_path / "out")
    df = st.live_features(stream(spark, folder), "1 day", 2, frame(spark, rows[:50]))
    finish(st.start(df, out, str(tmp_path / "check"), lambda df: df.select("id", "late", *FEATURE)))
    want = velocity.features(frame(spark, rows)).filter(F.col("id").isin([r[0] for r in rows[50:]]))
    got = {r.id: r for r in spark.read.schema("id bigint, " + ", ".join(f"{c} double" for c in FEATURE)).json(out).collect()}
    assert len(got) == 40
    for r in want.collect():
        assert {c: got[r.id][c] for c in FEATURE} == pytest.approx({c: r[c] for c in FEATURE}), r.id


def test_many_cards_and_rows_of_one_key(spark, tmp_path):
    """More rows than a segment and more cards than a head hold, over several batches."""
    rows = [tuple({"id": i, "dt": 1_000 + i * 400, "amount": float(i % 13), "card1": float(i % 150), "device_info": "d", "purchaser_email_domain": "e" if i % 2 else None}.get(c) for c in SCHEMA.replace(",", "").split()[0::2]) for i in range(900)]
    end = rows[-1][1]
    folder = feed(tmp_path, [*[rows[i : i + 300] for i in (0, 300, 600)], [heartbeat(end + 86_400)], [heartbeat(end + 86_401)]])
    out = str(tmp_path / "out")
    finish(st.start(st.live_features(stream(spark, folder), "1 minute", 2), out, str(tmp_path / "check"), lambda df: df.select("id", "late", *FEATURE)))
    same(spark, out, rows)


def test_rules_over_the_stream_count_what_they_count_over_the_table(spark, tmp_path):
    fields = ["card_txn_count_1h", "card_txn_count_24h", "card_amount_sum_7d", "uid_amount_sum_24h", "device_txn_count_7d", "email_txn_count_24h", "card_amount_ratio_7d", "distinct_cards_per_email_24h"]
    texts = [f"{a} if :{f}: > {v}" for a, f, v in zip(["block", "review"] * 4, fields, (1, 2, 50, 30, 3, 2, 1.2, 1), strict=True)]
    texts += ["shadow block if :card_seconds_since_last: < 600", "shadow review if is_missing(:uid_seconds_since_first:)", "review if :amount: > 50 and :device_txn_count_1h: > 0", "allow if :email_mean_amount_7d: < 5", "shadow block if :distinct_cards_per_device_24h: >= 2"]
    assert len(texts) == 13
    rules, rows, out = RuleSet.load("\n".join(texts)), rows_of(60, 8), str(tmp_path / "out")
    folder = feed(tmp_path, [rows[:30], rows[30:], [heartbeat(rows[-1][1] + 86_400)], [heartbeat(rows[-1][1] + 86_401)]])
    full = lambda df: df.withColumns({"risk_score": F.lit(None).cast("double"), "fraud": F.col("is_fraud")})
    table = full(velocity.features(frame(spark, rows)))
    finish(st.start(st.live_features(stream(spark, folder), "1 day", 2), out, str(tmp_path / "check")))
    streamed = full(spark.read.schema(table.drop("fraud", "risk_score").schema).json(out))
    counted = [sorted(map(str, ruleset.rule_stats(ruleset.decide(t, rules), rules).collect())) for t in (streamed, table)]
    assert counted[0] == counted[1] and len(counted[0]) == 13


def test_replayed_files_give_the_batch_too(spark, tmp_path):
    rows = rows_of(30, 3)
    st.replay(frame(spark, rows), str(tmp_path / "in"), 3)
    feed(tmp_path, [[heartbeat(rows[-1][1] + 86_400)], [heartbeat(rows[-1][1] + 86_401)]])
    out = str(tmp_path / "out")
    finish(st.start(st.live_features(spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.json").json(str(tmp_path / "in")), "10 seconds", 2), out, str(tmp_path / "check"), lambda df: df.select("id", "late", *FEATURE)))
    same(spark, out, rows)


class Map:
    """A map of state, with what was written to it."""

    def __init__(self):
        self.held, self.written = {}, 0

    def getValue(self, key):  # noqa: N802
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value
        self.written += len(value[0]) if isinstance(value[0], bytes) else 8

    def removeKey(self, key):  # noqa: N802
        self.held.pop(key, None)


def history(maps=None, head=None):
    segments, cards = maps or (Map(), Map())
    return keyed.KeyHistory(keyed.Shelf(segments, cards, "k"), head)


def test_history_takes_late_rows_at_its_latest_time():
    h = history()
    h.take(100, 5.0, 5000, 1.0)
    out = dict(zip(keyed.PER_KEY, h.take(50, 7.0, 7000, 2.0), strict=True))
    assert out["txn_count_1h"] == 1 and out["seconds_since_last"] == 0 and h.last == 100


@pytest.mark.parametrize(("steps", "batch"), [((0, 1, 600, 3_600, 86_400, 200_000), 37), ((0, 1, 2, 300), 150), ((0, 60, 5_000_000), 1)])
def test_history_equals_a_count_of_every_row(monkeypatch, steps, batch):
    monkeypatch.setattr(keyed, "SEGMENT", 5)
    monkeypatch.setattr(keyed, "CARDS", 2)
    rng, maps, done = random.Random(4), (Map(), Map()), []
    h, dt, first = history(maps), 0, 0
    for i in range(900):
        gap = rng.choice(steps)
        dt += gap
        first = dt if gap >= keyed.IDLE_TTL or not done else first
        amount, card = rng.randint(1, 900), rng.choice([None, 1.0, 2.0, 3.0, 4.0])
        got = dict(zip(keyed.PER_KEY, h.take(dt, amount / 1000, amount, card), strict=True))
        for w, seconds in keyed.WINDOWS.items():
            inside = [m for t, m, _ in done if t > dt - seconds]
            assert (got[f"txn_count_{w}"], got[f"amount_sum_{w}"]) == (len(inside), sum(inside) / 1000)
        assert got["distinct_cards"] == len({c for t, _, c in done if c is not None and t > dt - 86_400})
        assert got["seconds_since_first"] == (dt - first if done and gap < keyed.IDLE_TTL else None)
        done.append((dt, amount, card))
        if i % batch == 0:  # written and read back
            h = history(maps, pickle.loads(pickle.dumps(h.head())))
    h.leave(dt + keyed.IDLE_TTL)
    assert h.head()[4] == [] and not maps[0].held and not maps[1].held


def test_what_a_batch_writes_does_not_grow_with_the_week():
    maps, head, sizes = (Map(), Map()), None, []
    for batch in range(60):
        before, h = maps[0].written, history(maps, head)
        for i in range(100):
            h.take(batch * 6_000 + i * 60, 1.0, 1_000, float(i % 7))
        head = h.head()
        sizes.append(maps[0].written - before + len(pickle.dumps(head)))
    assert head[6][7 * 86_400] > 5_900 and max(sizes[-10:]) < 1.2 * max(sizes[:10])


def released(spark, tmp_path, batches):
    """What the stream of one batch a file says of each payment, and where its checkpoint is."""
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    df = st.velocity_parts(stream(spark, feed(tmp_path, batches)), "1 minute", shards=2)
    finish(df.writeStream.format("json").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start())
    return {r.id: r for r in spark.read.schema(keyed.PART).json(out).filter("entity = 'card'").collect()}, check


def payment(id_, dt, card=5.0, amount=10.0):
    named = {"id": id_, "dt": dt, "card1": card, "amount": amount}
    return tuple(named.get(c) for c in SCHEMA.replace(",", "").split()[0::2])


def test_payments_behind_the_watermark_are_kept_and_clamped(spark, tmp_path):
    batches = [[payment(1, 1_000), payment(2, 5_000)], [heartbeat(50_000)], [heartbeat(50_001)], [payment(3, 2_000), payment(4, 49_990)], [heartbeat(90_000)], [heartbeat(90_001)]]
    got, _ = released(spark, tmp_path, batches)
    assert {i: r.late for i, r in got.items()} == {1: False, 2: False, 3: True, 4: False}
    # 3 counts as if it came at 5,000; 4 is within the delay and sees all three
    assert (got[3].txn_count_24h, got[3].seconds_since_last) == (2, 0)
    assert (got[4].txn_count_24h, got[4].seconds_since_last, got[4].seconds_since_first) == (3, 44_990, 48_990)


def test_idle_keys_are_forgotten(spark, tmp_path):
    month = 30 * 86_400
    batches = [[payment(1, 100), payment(2, 100, 6.0)], [payment(3, 20 * 86_400)], [heartbeat(month + 500)], [heartbeat(month + 501)], [payment(4, month + 600), payment(5, month + 600, 6.0)], [heartbeat(month + 900)], [heartbeat(month + 901)]]
    got, check = released(spark, tmp_path, batches)
    assert got[4].seconds_since_first == month + 500 and got[5].seconds_since_first is None
    feed(tmp_path, [[heartbeat(3 * month)], [heartbeat(3 * month + 1)]])
    released(spark, tmp_path, [])
    assert st.state_summary(spark, check).count() == 0


def test_records_for_a_topic(spark):
    rows = st.kafka_records(spark.createDataFrame([(1, "a"), (2, None)], "id bigint, `odd.name` string"), "id", 8).collect()
    assert [(r.key, json.loads(r.value)) for r in rows] == [("1", {"id": 1, "odd.name": "a"}), ("2", {"id": 2})]
    assert [r.partition for r in rows] == [int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 8 for i in (1, 2)]


def test_once_and_conflicts(spark, tmp_path):
    folder = tmp_path / "e"
    folder.mkdir()
    (folder / "a.json").write_text('{"event_id": "1", "ts": "2024-01-01T00:00:00Z"}\n{"event_id": "1", "ts": "2024-01-01T00:00:05Z"}\n{"event_id": "2", "ts": "2024-01-01T00:00:05Z"}')
    df = spark.readStream.schema("event_id string, ts timestamp").json(str(folder))
    q = st.once(df, "event_id").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    finish(q)
    assert spark.table("once").count() == 2
    r = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "a"), ("l", "a")], "idempotency_key string, body string")
    assert [x.idempotency_key for x in st.key_conflicts(r).collect()] == ["k"]


def test_dead_letters_and_labels(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "a.txt").write_text('{"payment_id": "txn_1", "created": 1600000000, "amount": 5}\nnonsense\n')
    raw = spark.readStream.text(str(folder))
    finish(st.split_dead_letters(records.decode_payments(raw), str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "c1")))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "dead")).first().value == "nonsense"
    schema = "type string, created bigint, payment_id string, dispute_id string, reason string, status string, amount bigint, seq bigint"
    events = [(labels.CREATED, 5, "txn_1", "a", "fraudulent", "open", 1, 1), (labels.CLOSED, 9, "txn_1", "a", "fraudulent", "won", 1, 2), (labels.CREATED, 7, "txn_2", "b", "fraudulent", "open", 1, 3)]
    (tmp_path / "l").mkdir()
    names = schema.replace(",", "").split()[0::2]
    for i, e in enumerate(events):
        (tmp_path / "l" / f"{i}.json").write_text(json.dumps(dict(zip(names, e, strict=True))))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(str(tmp_path / "l"))
    finish(st.keep_labels(df, str(tmp_path / "states"), str(tmp_path / "c2")))
    last = spark.read.parquet(str(tmp_path / "states" / "v2"))
    want = labels.dispute_states(spark.createDataFrame(events, schema))
    assert sorted(map(tuple, last.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_arrival_order_is_not_event_order(spark, tmp_path):
    rows = [r for r in rows_of(40, 12) if r[4] is not None]
    folder = feed(tmp_path, [rows[20:], rows[:20]])
    df = stream(spark, folder).withColumn("device_info", F.lit(None).cast("string")).withColumn("purchaser_email_domain", F.lit(None).cast("string")).withColumn("d1", F.lit(None).cast("double"))
    out = str(tmp_path / "parts")
    q = st.velocity_parts(df, "3650 days", ordered=False, shards=2).writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    finish(q)
    assert spark.read.json(out).filter("late").count() > 0


def test_answers_are_kept_for_a_while(spark, tmp_path):
    """Replays, conflicts, age and capacity, over batches, against a plain store."""
    rng = random.Random(2)
    batches = [[{"key": f"k{rng.randint(0, 9)}", "at": b * 50 + rng.randint(0, 49), "body": rng.choice("xy"), "answer": f"{b}-{i}"} for i in range(25)] for b in range(3)]
    batches[1].append({"key": None, "at": 60, "body": "x", "answer": "none"})
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    df = spark.readStream.schema("key string, at bigint, body string, answer string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    finish(st.start(st.answered(df, ttl=40, capacity=4, shards=1), out, str(tmp_path / "check")))
    held, want = {}, []
    for rows in batches:
        digest = lambda r: hashlib.sha256(r["body"].encode()).hexdigest()
        for r in sorted(rows, key=lambda r: (r["at"], r["key"] or f"\0{r['at']}\0{digest(r)}", digest(r))):
            name = r["key"] or f"\0{r['at']}\0{digest(r)}"
            held = {k: v for k, v in held.items() if r["at"] - v["at"] < 40}
            if name in held:
                same = held[name]["body"] == r["body"]
                want.append((r["key"], r["at"], "replayed" if same else "conflict", held[name]["answer"] if same else None))
                continue
            held[name] = r
            while len(held) > 4:
                del held[next(iter(held))]
            want.append((r["key"], r["at"], "first", r["answer"]))
    got = spark.read.schema("key string, at bigint, status string, answer string").json(out).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and {w[2] for w in want} == {"first", "replayed", "conflict"}

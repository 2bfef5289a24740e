from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_velocity import frame, history

from tidemark.operators import audit, labels, model
from tidemark.operators.ruleset import decide
from tidemark.operators.velocity import feature_table
from tidemark.plans import samples
from tidemark.sources import payments, records, synthetic, tables

HEAD = "TransactionID,TransactionDT,TransactionAmt,ProductCD,card1,card4,card6,addr1,addr2,dist1,P_emaildomain,R_emaildomain,D1,extra,isFraud\n"


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    t = write(tmp_path, "t.csv", HEAD + "2,86400.0,10.5,W,1001,visa,,300,,,a.com,,3,zz,1\n1,86400,7,,,,,,,,,,,,\n")
    i = write(tmp_path, "i.csv", "TransactionID,DeviceType,DeviceInfo\n2,mobile,ios\n9,desktop,\n")
    got = {r.id: r for r in payments.load(spark, t, i).collect()}
    assert set(got) == {1, 2} and got[2].dt == 86400 and got[2].device_info == "ios" and got[2].is_fraud == 1
    assert got[1].card1 is None and got[1].product_code is None and got[1].is_fraud == -1 and got[1].device_type is None


@pytest.mark.parametrize(
    ("row", "said"),
    [("1,2,x,W,,,,,,,,,,,0", "TransactionAmt"), ("1.5,2,1,W,,,,,,,,,,,0", "TransactionID"), (",2,1,W,,,,,,,,,,,0", "TransactionID"), ("1,2,1,W,,,,,,,,,,,2", "isFraud"), ("1,2,1,W,,,,,,,,,,,0\n1,2,3,W,,,,,,,,,,,0", "one place")],
)
def test_bad_csv(spark, tmp_path, row, said):
    with pytest.raises(Exception, match=said):
        payments.load(spark, write(tmp_path, "t.csv", HEAD + row + "\n")).collect()


def test_bad_identity_and_header(spark, tmp_path):
    twice = write(tmp_path, "i.csv", "TransactionID,DeviceType,DeviceInfo\n2,mobile,ios\n2,desktop,x\n")
    with pytest.raises(Exception, match="identity given twice"):
        payments.read_identity(spark, twice).collect()
    with pytest.raises(payments.SchemaError, match="card1"):
        payments.read_transactions(spark, write(tmp_path, "t.csv", HEAD.replace("card1", "carb1")))


def test_decode_payments(spark):
    body = {"payment_id": "txn_7", "created": payments.EPOCH + 60, "amount": 1999, "risk_fields": {"card1": 5, "card4": "", "DeviceInfo": "x", "addr1": None, "TransactionAmt": 19.994}}
    bad = [{**body, "payment_id": ""}, {**body, "created": 0}, {**body, "amount": -1}, {**body, "risk_fields": {"card_1": 1}}, {**body, "risk_fields": {"card1": "5"}}, {**body, "risk_fields": {"card4": 5}}, {**body, "created": records.YEAR_3000}]
    lines = [json.dumps(body), json.dumps({"payment_id": "pay_9", "created": payments.EPOCH + 5, "amount": 250}), "{", *map(json.dumps, bad)]
    d = records.decode_payments(spark.createDataFrame([(x,) for x in lines], "value string"))
    ok = {r.payment_id: r for r in records.good(d).collect()}
    assert ok["txn_7"].id == 7 and ok["txn_7"].dt == 60 and ok["txn_7"].amount == 19.994 and ok["txn_7"].card_network is None and ok["txn_7"].device_info == "x"
    assert ok["pay_9"].amount == 2.5 and ok["pay_9"].id == 0 and ok["pay_9"].card1 is None
    assert records.dead(d).count() == 1 + len(bad)


def test_events(spark):
    opened = {"id": "e1", "type": "charge.dispute.created", "created": 5, "data": {"object": {"id": "d1", "payment_intent": "txn_1", "amount": 3, "reason": "fraudulent", "status": "open"}}}
    df = records.decode_events(spark.createDataFrame([(json.dumps(opened),), (json.dumps({**opened, "type": "other"}),), ("[]",), ("{}",)], "value string"))
    rows = df.collect()
    assert rows[0].error is None and rows[0].payment_id == "txn_1" and rows[0].dispute_id == "d1" and all(r.error for r in rows[1:])


def test_signatures():
    p, now = b'{"a":1}', 1000
    good = records.sign(b"k", p, now)
    err = lambda h, secrets=(b"k",), at=now, tol=300: records.signature_error(h, p, secrets, at, tol)
    assert err(good) is None and err(good, (b"old", b"k")) is None and err(" " + good.replace(",", " ,\tv0=x,")) is None
    assert err(good, at=1300) is None and err(good, at=1301) == records.STALE and err(good, at=699) == records.STALE
    assert err(good, (b"no",)) == records.UNSIGNED and err(good, ()) == records.UNSIGNED and err(good, (b"k", b"")) == records.UNSIGNED
    assert err(good.upper().replace("T=", "t=").replace("V1", "v1")) == records.UNSIGNED
    for h in ("", None, "t=1", "v1=a", "t=1,t=2,v1=a", "t=-1,v1=a", "t=1234567890123456,v1=a", "t=1,v1=", "t=1,v1=a,x", "=1,t=1,v1=a"):
        assert err(h) == records.MALFORMED, h


def test_tables_export_and_log(spark, tmp_path):
    table = feature_table(frame(spark, [(*r[:4], None if r[4] != r[4] else r[4], *r[5:]) for r in history(120)]))
    table = model.score(table, samples.model(), samples.ENCODER, samples.CALIBRATION)
    path = str(tmp_path / "table")
    tables.save_table(table, path)
    back = tables.load_table(spark, path)
    assert back.count() == 120
    with pytest.raises(tables.TableError):
        back.drop("amount").write.parquet(str(tmp_path / "other"))
        tables.load_table(spark, str(tmp_path / "other"))
    manifest = tables.export(back, str(tmp_path / "x"), month_days=20)
    assert sum(s["rows"] for s in manifest["splits"].values()) == 120
    read = tables.read_export(spark, str(tmp_path / "x"))
    assert set(r.split for r in read.select("split").distinct().collect()) <= {"train", "valid"}
    rules = samples.rules()
    log = records.decisions(decide(table, rules), 1, "m")
    log.coalesce(1).write.json(str(tmp_path / "log"))
    lines = next((tmp_path / "log").glob("part-*")).read_text()
    (tmp_path / "torn").mkdir()
    write(tmp_path / "torn", "a.jsonl", lines + '{"payment_id": "torn')
    read = records.read_decisions(spark, str(tmp_path / "torn"))
    assert read.count() == 120
    good = audit.audit(read, {1: rules}, samples.model(), samples.ENCODER, samples.CALIBRATION, "m")
    assert good.filter("size(mismatches) > 0").count() == 0
    wrong = read.withColumn("decision", F.lit("nothing")).withColumn("ruleset_version", F.when(F.col("created") % 2 == 0, 1).otherwise(9).cast("bigint"))
    bad = {tuple(r.mismatches) for r in audit.audit(wrong, {1: rules}, samples.model(), samples.ENCODER, samples.CALIBRATION, "m").collect()}
    assert ("ruleset_version",) in bad and any("decision" in b for b in bad)
    with pytest.raises(Exception, match="another model"):
        audit.audit(read, {1: rules}, samples.model(), samples.ENCODER, samples.CALIBRATION, "other").collect()
    (tmp_path / "bad").mkdir()
    write(tmp_path / "bad", "a.jsonl", '{"payment_id": "a"}\nnonsense}\n')
    with pytest.raises(Exception, match="not a decision"):
        records.read_decisions(spark, str(tmp_path / "bad")).collect()


def test_only_a_last_line_without_its_end_may_be_torn(spark, tmp_path):
    good = [f'{{"payment_id": "txn_{i}", "note": "{"x" * 50}"}}' for i in range(40)]

    def read(name, *files):
        (tmp_path / name).mkdir()
        for i, text in enumerate(files):
            (tmp_path / name / f"{i}.jsonl").write_bytes(text.encode())
        return sorted(r.payment_id for r in records.read_decisions(spark, str(tmp_path / name)).collect())

    whole, all_ = "\n".join(good) + "\n", sorted(f"txn_{i}" for i in range(40))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # several parts to a file
    try:
        assert read("whole", whole) == read("open", whole[:-1]) == read("blank", "\n\n" + whole + "\n  \n") == all_
        assert read("torn", whole + '{"payment_id": "tx') == read("closed", whole + '{"payment_id": "a}') == read("windows", whole.replace("\n", "\r\n") + "{") == all_
        assert read("two", whole + "{", "{" + "x" * 40) == all_
        for name, text in {"first": "{\n" + whole, "middle": "\n".join([*good[:20], '{"pay', *good[20:]]), "ended": whole + "{\n", "both": "x\n" + whole + "{", "late": whole + "{\n\n", "other": whole + "7\n"}.items():
            with pytest.raises(ValueError, match=f"{name}/0.jsonl: 1 lines are not a decision"):
                read(name, text, whole + "{")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


WRONG = ['{"payment_id": "txn_2", "created": "soon"}', '{"payment_id": "txn_2", "created": 1.5}', '{"payment_id": "txn_2", "ruleset_version": "x"}', '{}', '{"payment_id": 7}', '{"payment_id": null, "created": 3}', '{"payment_id": "a", "scored": 1}',
         '{"payment_id": "a", "shadow_matches": "r"}', '{"payment_id": "a", "shadow_matches": ["r", 1]}', '{"payment_id": "a", "features": [1, {}]}', '{"payment_id": "a", "contributions": {"x": "1"}}', '{"payment_id": "a", "contributions": [1]}', '{"payment_id": "a", "bias": "0.5"}', '["a"]']


@pytest.mark.parametrize("place", [0, 20, 40])
def test_values_of_a_wrong_type_are_errors(spark, tmp_path, place):
    good = [f'{{"payment_id": "txn_{i}", "created": {i}, "bias": 1, "risk_score": null, "features": ["a", 1, 0.5, null], "shadow_matches": [], "contributions": {{"x": 1}}}}' for i in range(40)]
    for end in ("\n", ""):  # a whole line of a wrong type is no torn one, even at the end
        for n, wrong in enumerate(WRONG):
            (path := tmp_path / f"{n}{len(end)}").mkdir()
            write(path, "a.jsonl", "\n".join([*good[:place], wrong, *good[place:]]) + end)
            with pytest.raises(ValueError, match="1 lines are not a decision"):
                records.read_decisions(spark, str(path))
    (path := tmp_path / "good").mkdir()
    write(path, "a.jsonl", "\n".join(good))
    rows = records.read_decisions(spark, str(path)).collect()
    assert len(rows) == 40 and rows[0].bias == 1 and rows[0].features == ["a", "1", "0.5", None] and rows[0].risk_score is None


def test_cached(spark, tmp_path):
    src, calls = write(tmp_path, "s.csv", "x\n1\n"), []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), (src,), build).count() == 3
    write(tmp_path, "s.csv", "x\n12\n")
    tables.cached(spark, str(tmp_path / "c"), (src,), build)
    assert len(calls) == 2


def test_rule_history():
    h = tables.RuleHistory()
    a = h.add("shadow block if :amount: > 1")
    h.add("block if :amount: > 1")
    h.add("shadow block if :amount: > 1.0\nallow if :amount: > 9")
    assert h.current.version == 3 and h.live_in(a.rules[0].id) == [1, 3] and len(h.items()) == 3


def test_labels(spark):
    schema = "type string, created bigint, payment_id string, dispute_id string, reason string, status string, amount bigint, seq bigint"
    o, c = labels.CREATED, labels.CLOSED
    rows = [(o, 10, "txn_1", "a", "fraudulent", "open", 1, 1), (c, 10, "txn_1", "a", "fraudulent", "won", 1, 0), (o, 5, "txn_2", "b", "fraudulent", "open", 1, 2), (c, 9, "txn_3", "c", "duplicate", "lost", 1, 3), (o, 4, "txn_2", "b", "duplicate", "open", 1, 9)]
    events = spark.createDataFrame(rows, schema)
    got = {r.payment_id: r.label for r in labels.payment_labels(labels.dispute_states(events)).collect()}
    assert got == {"txn_1": 0, "txn_2": 1, "txn_3": -1}
    half = labels.upsert(labels.dispute_states(events.limit(2)), events)
    assert sorted(map(tuple, half.collect())) == sorted(map(tuple, labels.dispute_states(events).collect()))
    table = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "id bigint, fraud tinyint")
    assert {r.id: r.fraud for r in labels.overlay(table, labels.payment_labels(labels.dispute_states(events))).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_synthetic(spark):
    df = synthetic.generate(spark, rows=4000, days=30)
    r = df.agg(F.count("*").alias("n"), F.avg("is_fraud").alias("f"), F.min("dt").alias("a"), F.max("dt").alias("b")).first()
    assert r.n == 4000 and 0.02 < r.f < 0.05 and r.a >= 86400 and r.b < 32 * 86400
    assert df.exceptAll(synthetic.generate(spark, rows=4000, days=30)).isEmpty()

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import FIELDS, table_struct
from tidemark.operators import backtest as bt
from tidemark.operators import calendar, compare
from tidemark.operators.ruleset import RuleSet, decide, rule_stats, set_stats
from tidemark.plans.checking import Scope, load_rules
from tidemark.plans.interpret import matches

RULES = RuleSet.load("allow if :distance: > 90\nblock if :amount: > 400\nreview if :billing_region: = 3\nshadow block if :amount: > 100\nblock if :distance: < 5")
DAY = 86_400


def table(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        f = dict.fromkeys(x.name for x in FIELDS)
        f |= {"amount": round(rng.uniform(1, 600), 2), "distance": rng.choice([None, rng.uniform(0, 100)]), "billing_region": float(rng.randint(1, 5)), "risk_score": rng.choice([None, -1.0, float(rng.randint(0, 130)), 45.5])}
        rows.append((i, 1000 + rng.randint(0, 100 * DAY), rng.choice([0, 0, 0, 1, -1]), rng.choice([None, 50 * DAY]), *[f[x.name] for x in FIELDS]))
    schema = table_struct()
    return spark.createDataFrame(rows, schema), [dict(zip(schema.names, r, strict=True)) for r in rows]


def decided(row):
    hit = [matches(r.condition, row, Scope()) for r in RULES.rules]
    for i, r in RULES.live():
        if hit[i]:
            return hit, r.action, i
    return hit, "allow", -1


@pytest.mark.parametrize("action", ["allow if :amount: < 500", "block if :amount: > 50", "review if :risk_score: >= 40"])
@pytest.mark.parametrize("timed", [False, True])
def test_report_against_rows(spark, action, timed):
    df, rows = table(spark)
    rule = load_rules(action)[0][0]
    options = bt.Options(start=5 * DAY, end=95 * DAY, as_of=95 * DAY, maturity=20 * DAY, use_label_time=timed)
    want = {}
    for r in rows:
        if not 5 * DAY <= r["dt"] < 95 * DAY:
            continue
        hit, act, _ = decided(r)
        fraud = r["fraud"] == 1 and not (timed and (r["label_time"] is None or r["label_time"] > 95 * DAY))
        legit = r["fraud"] == 0 or (r["fraud"] == 1 and not fraud)
        groups = ["immature"] if r["dt"] >= 75 * DAY else ["period"]
        if groups == ["period"] and matches(rule.condition, r, Scope()):
            groups.append("matched")
            allowed = hit[0]
            changed = {"allow": act != "allow", "block": not allowed and act != "block", "review": not allowed and act == "allow"}[rule.action]
            groups += ["changed"] * changed + ["overrides_block"] * (changed and act == "block" and rule.action == "allow") + ["overrides_review"] * (changed and act == "review" and rule.action == "allow") + ["from_review"] * (changed and act == "review" and rule.action == "block")
        for g in groups:
            s = want.setdefault(g, [0, 0, 0, 0, 0])
            s[0] += 1
            s[1] += round(r["amount"] * 1000)
            s[2] += fraud and g != "immature"
            s[3] += legit and g != "immature"
            s[4] += round(r["amount"] * 1000) * (fraud and g != "immature")
    for r in bt.report(decide(df, RULES), RULES, rule, options).collect():
        s = want.get(r.grp, [0] * 5)
        assert [r.payments, r.fraud, r.legit] == [s[0], s[2], s[3]] and r.dollars == s[1] / 1000 and r.fraud_dollars == s[4] / 1000, r
        assert r.unlabeled == s[0] - s[2] - s[3]
        if r.grp == "changed":
            assert r.precision == (s[2] / (s[2] + s[3]) if s[2] + s[3] else None) and r.fraud_count_share == s[2] / want["period"][2]


def test_sweep_against_a_hundred_scans(spark):
    df, rows = table(spark)
    for given in (False, True):
        got = {r.threshold: r for r in bt.sweep(decide(df, RULES), RULES, bt.Options(maturity=-1), given).collect()}
        assert sorted(got) == list(range(100))
        for k in (0, 1, 45, 46, 99):
            hit = [r for r in rows if r["risk_score"] is not None and r["risk_score"] >= k and not (given and decided(r)[0][0])]
            assert got[k].payments == len(hit) and got[k].fraud == sum(r["fraud"] == 1 for r in hit) and got[k].dollars == sum(round(r["amount"] * 1000) for r in hit) / 1000


def test_stats_against_rows(spark):
    df, rows = table(spark)
    d = decide(df, RULES)
    for s in rule_stats(d, RULES).collect():
        hit = [r for r in rows if decided(r)[0][s.rule_index]]
        assert s.matched == len(hit) and s.fraud == sum(r["fraud"] == 1 for r in hit) and s.decided == sum(decided(r)[2] == s.rule_index for r in rows)
    s = set_stats(d).first()
    flagged = [r for r in rows if decided(r)[1] != "allow"]
    assert s.flagged == len(flagged) and s.flagged_fraud == sum(r["fraud"] == 1 for r in flagged) and s.recall == s.flagged_fraud / s.frauds


def test_options(spark):
    df, rows = table(spark)
    low, high = min(r["dt"] for r in rows), max(r["dt"] for r in rows)
    assert bt.Options().resolved(df) == bt.Options(low, high + 1, high + 1, 60 * DAY)
    with pytest.raises(ValueError):
        bt.Options(start=5, end=5).resolved(df)
    with pytest.raises(ValueError):
        bt.label_delay(decide(df, RULES), RULES, RULES.rules[1], 1, 0, 1)


def test_backtester_says_what_it_found(spark):
    df, _ = table(spark)
    b = bt.Backtester(df, RULES)
    out = b.run(load_rules("block if :amount: > 450")[0][0], bt.Options(maturity=-1))
    assert out["unreachable"] and out["covered_by"][0]["rule_index"] in (0, 1) and "changed: none" in out["summary"]
    out = b.run(load_rules("shadow review if :amount: > 50")[0][0], bt.Options(maturity=10 * DAY))
    assert len(out["samples"]) == 10 and "review over" in out["summary"] and len(out["warnings"]) == 1
    assert "matches no payment" in b.run(load_rules("block if :amount: > 10000")[0][0], bt.Options(maturity=-1))["warnings"][0]
    b.close()


def test_words():
    zero = dict.fromkeys(bt.MEASURES, 0)
    rows = [{"grp": "period", **zero, "payments": 200, "dollars": 1234.5, "fraud": 8}, {"grp": "changed", **zero, "payments": 3, "dollars": 20.25, "fraud": 2}, {"grp": "from_review", **zero}]
    assert bt.facts(rows) == [("period", "payments", 200, None), ("period", "dollars", 1234.5, None), ("period", "fraud", 8, None), ("changed", "payments", 3, None), ("changed", "dollars", 20.25, None), ("changed", "fraud", 2, 0.25)]
    text = bt.summary(rows, load_rules("block if :amount: > 1")[0][0], bt.Options(0, 10 * DAY, 7 * DAY, -1, True))
    assert text.split("\n") == ["block over 10 days, labels known 3 days before their end", "period: payments 200, dollars 1,234, fraud 8", "changed: payments 3, dollars 20.2, fraud 2 (25 %)", "from review: none"]


def test_delay():
    d = bt.Delay()
    days = d.days(np.arange(200_000))
    assert abs(np.median(days) - 30) < 0.3 and abs((days <= 60).mean() - d.arrived_within(60)) < 0.004 and d.arrived_within(0) == 0
    assert abs(d.arrived_within(60) - 0.5 * math.erfc(-math.log(2) / 0.5 / math.sqrt(2))) < 1e-12 and d.arrived_within(500) == d.arrived_within(120)
    assert (bt.Delay(seed=2).days(np.arange(5)) != days[:5]).all() and (d.days(np.array([7, 3])) == days[[7, 3]]).all()


def test_calendar(spark):
    df = spark.createDataFrame([(100 + d * DAY, 1) for d in (0, 29, 30, 119, 120, 149, 150, 900)], "dt bigint, fraud int")
    origin = calendar.first_day(df)
    assert [r[0] for r in df.select(calendar.month(origin)).collect()] == [0, 0, 1, 3, 4, 4, 5, 5]
    assert {r.split: r["rows"] for r in calendar.split_counts(df).collect()} == {"train": 4, "valid": 2, "test": 2}


def test_parity(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id bigint, x double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (4, 4.0), (3, 3.5)], "id bigint, x double")
    assert {r.what: r.n for r in compare.parity(a, b, ["x"]).collect()} == {"only_left": 0, "only_right": 1, "both": 3, "differs:x": 1}
    assert compare.score_parity(a, b, "x").first().max_diff == 0.5
    assert compare.top_keys(a.withColumn("k", F.col("id") % 2), "k", 1).first().events == 2

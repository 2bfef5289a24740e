"""Rules three ways: Spark columns, plain Python, and DuckDB."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_language import random_condition

from tidemark.operators.ruleset import RuleSet, decide
from tidemark.plans.checking import ListTable, Scope, load_rules
from tidemark.plans.compiling import column, sql, with_conditions
from tidemark.plans.interpret import lower, value
from tidemark.plans.language import RuleError, parse, show

SCHEMA = "id int, amount double, distance double, billing_region double, device_info string, product_code string, purchaser_email_domain string"
NUMBERS = [None, 0.0, -0.0, 1.0, 2.5, 100.0, -3.0, 5e-324, 1e-300, float("inf"), float("-inf"), 2.0**53 + 1, 1.7e308]
TEXTS = [None, "a", "ab", "gmail.com", "İx", "K", "ẞ", "οδος", "Σ", " "]


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, *[rng.choice(NUMBERS) for _ in range(3)], *[rng.choice(TEXTS) for _ in range(3)]) for i in range(n)]


def test_differential(spark):
    rng, data = random.Random(11), rows(120)
    names = SCHEMA.replace(",", "").split()[0::2]
    df = spark.createDataFrame(data, SCHEMA)
    conditions = [random_condition(rng) for _ in range(120)]
    got = df.select("id", *[column(c).alias(f"c{i}") for i, c in enumerate(conditions)]).orderBy("id").collect()
    con = duckdb.connect()
    con.register("t", df.toPandas().replace({float("nan"): None}))
    for i, c in enumerate(conditions):
        expected = [value(c, dict(zip(names, r, strict=True)), Scope()) for r in data]
        assert [g[f"c{i}"] for g in got] == expected, show(c)
    duck = [c for c in conditions if "lower" not in show(c) and "5e-324" not in repr(c)][:40]
    con.execute("CREATE TABLE u (id INT, amount DOUBLE, distance DOUBLE, billing_region DOUBLE, device_info VARCHAR, product_code VARCHAR, purchaser_email_domain VARCHAR)")
    con.executemany("INSERT INTO u VALUES (?, ?, ?, ?, ?, ?, ?)", data)
    for c in duck:
        out = con.execute(f"SELECT {sql(c)} FROM u ORDER BY id").fetchall()
        assert [r[0] for r in out] == [value(c, dict(zip(names, r, strict=True)), Scope()) for r in data], show(c)


def test_kleene_table(spark):
    df = spark.createDataFrame([(150.0,), (50.0,), (None,)], "amount double")
    cases = {":amount: > 100": [True, False, None], "not :amount: > 100": [False, True, None], ":amount: <= 100": [False, True, None], "is_missing(:amount:)": [False, False, True],
             ":amount: > 100 or true": [True] * 3, ":amount: > 100 and false": [False] * 3, ":amount: in @none": [False, False, None], ":amount: not in @none": [True, True, None]}
    scope = Scope(lists={"none": ()})
    for text, want in cases.items():
        c = parse(f"block if {text}")[0][0].condition
        assert [r[0] for r in df.select(column(c, scope)).collect()] == want, text


@pytest.mark.parametrize("sent", [10**6, 0])
def test_long_lists_are_joined(spark, monkeypatch, sent):
    """A hundred thousand values, as a list and as a table: present, absent and missing, and both ways of joining."""
    monkeypatch.setattr("tidemark.plans.compiling.SENT", sent)
    many = tuple(f"v{i:06}" for i in range(100_000))
    numbers = spark.range(100_000).select((F.col("id") / 2).alias("n")).union(spark.createDataFrame([(None,), (float("nan"),), (-0.0,)], "n double"))
    scope = Scope(lists={"many": many, "few": ("a",)}, tables={"halves": ListTable(numbers, "n"), "none": ListTable(numbers.limit(0), "n")})
    data = [(i, a, d, x) for i, (a, d, x) in enumerate([(0.5, -0.0, "v000007"), (0.25, None, "V000007"), (None, 3.0, None), (49_999.5, 1.0, "a"), (50_000.0, 0.0, "v100000"), *[(2.0, 1.0, "v000001")] * 40])]
    df = spark.createDataFrame(data, "id int, amount double, distance double, device_info string")
    texts = [":device_info: in @many", ":device_info: not in @many", "lower(:device_info:) in @many and not (:amount: in @halves)", ":amount: in @halves", ":distance: not in @halves", ":distance: in @none", ":distance: not in @none", ":device_info: in @few or :amount: + :distance: in @halves", "not (:device_info: in @many or :amount: in @halves)"]
    rules = {f"c{i}": load_rules(f"block if {t}", scope)[0][0].condition for i, t in enumerate(texts)}
    halves, plain = Scope(lists={"many": many, "few": ("a",), "halves": tuple(i / 2 for i in range(100_000)), "none": ()}), ["id", "amount", "distance", "device_info"]
    out = with_conditions(df, rules, scope)
    assert out.columns == [*df.columns, *rules]
    for r in out.collect():
        row = dict(zip(plain, data[r.id], strict=True))
        assert [r[c] for c in rules] == [value(x, row, halves) is True for x in rules.values()], row
    with pytest.raises(RuleError, match="halves"):
        load_rules("block if :amount: in @halfes", scope)
    with pytest.raises(RuleError, match="list of numbers"):
        load_rules("block if :device_info: in @halves", scope)


def test_lower_is_letter_by_letter(spark):
    for s in ("İ", "ΟΔΟΣ", "K", "ẞ", "ABC", "ǅ"):
        c = parse("block if lower(:device_info:) = :product_code:")[0][0].condition
        df = spark.createDataFrame([(s, lower(s))], "device_info string, product_code string")
        assert df.select(column(c)).first()[0] is True, s


def test_decision_order(spark):
    rules = RuleSet.load("review if :amount: > 1\nblock if :amount: > 2\nblock if :amount: > 3\nshadow allow if :amount: > 0\nallow if :amount: > 4\nallow if :amount: > 5")
    df = spark.createDataFrame([(float(x),) for x in range(7)] + [(None,)], "amount double")
    got = [(r.action, r.rule_index, len(r.shadow_matches)) for r in decide(df, rules).orderBy(F.col("amount").asc_nulls_last()).collect()]
    assert got == [("allow", -1, 0), ("allow", -1, 1), ("review", 0, 1), ("block", 1, 1), ("block", 1, 1), ("allow", 4, 1), ("allow", 4, 1), ("allow", -1, 0)]


def test_long_chain_of_conditions(spark):
    text = " or ".join(f":amount: = {i}" for i in range(400))
    rules = RuleSet.load(f"block if {text}")
    assert decide(spark.createDataFrame([(399.0,), (400.0,)], "amount double"), rules).filter("action = 'block'").count() == 1

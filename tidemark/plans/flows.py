"""Registered queries of what goes in and out: files, tables, logs, streams, rule texts and words."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import ENTITIES, FEATURES, FIELDS, IDLE_TTL, NUMBER
from tidemark.operators import audit, calendar, compare, labels, ruleset, velocity
from tidemark.operators import backtest as bt
from tidemark.operators import model as md
from tidemark.operators.ruleset import RuleSet
from tidemark.plans import oracle, samples, texts
from tidemark.plans import queries as q
from tidemark.plans.checking import load_rules, nearest
from tidemark.plans.compiling import holds
from tidemark.plans.compiling import sql as rule_sql
from tidemark.plans.language import RuleError, parse
from tidemark.plans.queries import query
from tidemark.scratch import scratch_dir, stored
from tidemark.sources import payments as pay
from tidemark.sources import records, tables
from tidemark.sources import synthetic as syn
from tidemark.streaming import pipeline as st


def _values(columns: str, *rows: tuple) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def _done(stream) -> None:
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


# -- files and tables ----------------------------------------------------------------


def csv_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The test payments as a transactions and an identity file, with columns and rows that readers must ignore."""
    folder, df = scratch_dir(spark), q.payments(spark, sf_dir)
    names = {new: old for old, (new, _) in {**pay.TRANSACTION, **pay.IDENTITY}.items()}
    flag = F.when(F.col("is_fraud") >= 0, F.col("is_fraud").cast("string")).otherwise("")
    moved = [F.col(new).alias(old) for old, (new, _) in pay.TRANSACTION.items()]
    df.select(F.lit("x").alias("V1"), *moved, flag.alias("isFraud")).write.csv(f"{folder}/transactions", header=True)
    known = df.filter("device_type IS NOT NULL").select(*[F.col(c).alias(names[c]) for c in ("id", "device_type", "device_info")], F.lit(1).alias("id_01"))
    orphan = known.limit(1).withColumn("TransactionID", F.lit(-5).cast("bigint"))
    known.unionByName(orphan).write.csv(f"{folder}/identity", header=True)
    return f"{folder}/transactions", f"{folder}/identity"


@query("csv_payments", q._P1)
def _(spark, sf_dir):
    return pay.load(spark, *csv_files(spark, sf_dir))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocity.feature_table(q.payments(spark, sf_dir))


@query("saved_table", f"{oracle.velocity(q._P1)} SELECT id, dt, is_fraud AS fraud, amount, device_info, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    folder = scratch_dir(spark)
    tables.save_table(_table(spark, sf_dir), f"{folder}/table")
    return tables.load_table(spark, f"{folder}/table").select("id", "dt", "fraud", "amount", "device_info", *FEATURES)


@query("cached_table", f"SELECT id, dt, amount, 1 AS builds FROM ({q._P1})")
def _(spark, sf_dir):
    """Two requests for a table of unchanged sources: the second one finds it built."""
    folder, builds = scratch_dir(spark), []

    def build() -> DataFrame:
        builds.append(1)
        return q.payments(spark, sf_dir).select("id", "dt", "amount")

    for _i in range(2):
        out = tables.cached(spark, f"{folder}/cache", (f"{sf_dir}/events.parquet",), build)
    return out.withColumn("builds", F.lit(len(builds)))


_ENCODED_SQL = q.SQL["encoded"]


@query("export_by_split", f"WITH p AS ({q._P1}) SELECT split, id, dt, amount, fraud FROM (SELECT *, {q._SPLIT} AS split, is_fraud AS fraud FROM p) WHERE split <> 'test'")
def _(spark, sf_dir):
    folder = scratch_dir(spark)
    tables.export(_table(spark, sf_dir), folder, q.MONTH_DAYS)
    return tables.read_export(spark, folder).select(F.col("split").cast("string").alias("split"), "id", "dt", "amount", "fraud")


@query("export_codes", f"SELECT * FROM ({_ENCODED_SQL}) WHERE id IN (SELECT id FROM (WITH p AS ({q._P1}) SELECT id, {q._SPLIT} AS split FROM p) WHERE split = 'valid')")
def _(spark, sf_dir):
    folder = scratch_dir(spark)
    tables.export(_table(spark, sf_dir), folder, q.MONTH_DAYS)
    return tables.read_export(spark, folder, ("valid",)).select("id", *q._ENCODED)


@query("export_manifest", q.SQL["split_counts"])
def _(spark, sf_dir):
    folder = scratch_dir(spark)
    tables.export(_table(spark, sf_dir), folder, q.MONTH_DAYS)
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    assert manifest["features"] == [f.name for f in FIELDS]
    return spark.createDataFrame([(s, n["rows"], n["fraud"]) for s, n in manifest["splits"].items()], "split string, rows bigint, fraud bigint")


# the sorted text of an encoder of hundreds of values: its codes come from a table
@query("encoded_by_table", f"WITH p AS ({q._P1}), q AS (SELECT id, 'k' || (id % 500) AS v, {q._SPLIT} AS split FROM p), e AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM q WHERE split = 'train')) SELECT id, code::DOUBLE AS device_info FROM q LEFT JOIN e USING (v)")
def _(spark, sf_dir):
    df = q.payments(spark, sf_dir).withColumn("device_info", F.concat(F.lit("k"), F.col("id") % 500))
    train = df.filter(calendar.split(calendar.first_day(df), q.MONTH_DAYS) == "train")
    return md.encode(df, md.fit_encoder(train, ("device_info",))).select("id", "device_info")


@query("predictions_joined", f"{q._DECIDED} SELECT id, action, action IN ('block', 'review') AS flagged FROM d")
def _(spark, sf_dir):
    done = q.decided(spark, sf_dir)
    return compare.covered(done.select("id", "action"), ruleset.flagged(done)).select("id", "action", "flagged")


@query("score_parity", f'{q._SCORED} SELECT count(*) AS "rows", count(*) FILTER (id % 3 <> 0) AS identical, 0.25::DOUBLE AS max_diff FROM t')
def _(spark, sf_dir):
    df = q.scored(spark, sf_dir).select("id", F.round("raw_score", 3).alias("raw_score"))
    other = df.withColumn("raw_score", F.when(F.col("id") % 3 == 0, F.col("raw_score") + 0.25).otherwise(F.col("raw_score")))
    return compare.score_parity(df, other, "raw_score").withColumn("max_diff", F.round("max_diff", 9))


# -- logs -----------------------------------------------------------------------------


@query("decision_log_scan", f"{q._DECIDED} SELECT 'txn_' || id AS payment_id, action AS decision, risk_score::BIGINT AS risk_score, amount FROM d")
def _(spark, sf_dir):
    """A log, one file of which is nothing but a torn line, read back; the features by their places in the catalog."""
    path, log = f"{scratch_dir(spark)}/log", q.logged(spark, sf_dir)
    log.select(F.to_json(F.struct(*log.columns)).alias("value")).write.text(path)
    torn = spark.createDataFrame([('{"payment_id": "txn_9", "crea',)], "value string")
    torn.coalesce(1).write.mode("append").option("lineSep", " ").text(path)
    read = records.feature_columns(records.read_decisions(spark, path))
    return read.select("payment_id", "decision", F.col("logged_risk").alias("risk_score"), "amount")


@query("audit_versions", f"SELECT id % 3 AS ruleset_version, count(*) AS records, count(*) FILTER (id % 3 <> 0) AS verified, count(*) FILTER (id % 3 = 0) AS mismatched, 0::BIGINT AS unscored FROM ({q._P1}) GROUP BY 1")
def _(spark, sf_dir):
    """Records of two versions, each audited by its own rules, and of a version that nobody knows."""
    other = RuleSet.load("block if :amount: > 90", samples.SCOPE, 2)
    scored = q.scored(spark, sf_dir)
    one = records.decisions(ruleset.decide(scored.filter("id % 3 <> 2"), q._RULES), 1, "m1")
    two = records.decisions(ruleset.decide(scored.filter("id % 3 = 2"), other), 2, "m1")
    version = F.pmod(F.substring("payment_id", 5, 20).cast("bigint"), F.lit(3))
    log = one.unionByName(two).withColumn("ruleset_version", version)
    return audit.audit_report(audit.audit(log, {1: q._RULES, 2: other}, q._MODEL, samples.ENCODER, samples.CALIBRATION, "m1"))


_LATEST = 1_700_000_000


@query("future_payments", f"SELECT id, dt + {pay.EPOCH} + (id % 5) * 1000000000000 AS created, id % 5 = 0 AS accepted FROM ({q._P1})")
def _(spark, sf_dir):
    df = q.payments(spark, sf_dir).select("id", (F.col("dt") + pay.EPOCH + (F.col("id") % 5) * 1_000_000_000_000).alias("created"))
    return df.withColumn("accepted", records.not_ahead(F.col("created"), F.lit(_LATEST)))


@query("signed_deliveries", f"SELECT id, CASE id % 4 WHEN 1 THEN 'no_matching_signature' WHEN 2 THEN 'timestamp_outside_tolerance' WHEN 3 THEN 'malformed_header' END AS signature_error FROM ({q._P1})")
def _(spark, sf_dir):
    """Deliveries signed for their payloads (by one of two secrets), for another payload, long ago, and not at all."""
    now, secrets, kind = 1_700_000_000, [b"old", b"new"], F.col("id") % 4
    df = q.payments(spark, sf_dir).select("id", F.lit(now).alias("now"), F.to_json(F.struct("id", "amount")).alias("payload"))
    t = F.when(kind == 2, now - 10_000).otherwise(now - 7)
    said = F.when(kind == 1, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    by = F.when(F.col("id") % 2 == 0, records.signed(secrets[0], said, t)).otherwise(records.signed(secrets[1], said, t))
    header = F.when(kind == 3, F.concat(F.lit("t="), t.cast("string"), F.lit(",v0=00"))).otherwise(by)
    return records.verify(df.withColumn("header", header), secrets).select("id", "signature_error")


@query("decisions_in_order", f"SELECT count(*) AS decisions, 0::BIGINT AS out_of_order FROM ({q._P1})")
def _(spark, sf_dir):
    """Decisions written in the order of events and read back, each with the one before it in its file, and each file with the one before."""
    path = f"{scratch_dir(spark)}/ordered"
    log = q.logged(spark, sf_dir)
    log = records.in_event_order(log.select("payment_id", "created"))
    log.select(F.to_json(F.struct("payment_id", "created")).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.from_json("value", "payment_id string, created bigint").alias("d"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select("file", "line", F.struct("d.created", F.substring("d.payment_id", 5, 20).cast("bigint").alias("id")).alias("at"))
    before = F.lag("at").over(Window.partitionBy("file").orderBy("line"))
    inside = lines.withColumn("wrong", F.coalesce(before > F.col("at"), F.lit(False)))
    files = inside.groupBy("file").agg(F.count("*").alias("n"), F.count_if("wrong").alias("wrong"), F.min("at").alias("low"), F.max("at").alias("high"))
    between = F.coalesce(F.lag("high").over(Window.orderBy("file")) > F.col("low"), F.lit(False))
    return files.withColumn("between", between).agg(F.sum("n").alias("decisions"), (F.sum("wrong") + F.count_if("between")).alias("out_of_order"))


@query("topic_records", f"SELECT id::VARCHAR AS key, ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 16 AS partition, id AS said_id, dt AS said_dt FROM ({q._P1})")
def _(spark, sf_dir):
    """What a topic of 16 partitions would get."""
    sent = st.kafka_records(q.payments(spark, sf_dir).select("id", "dt"), "id", 16)
    said = F.from_json("value", "id bigint, dt bigint")
    return sent.select("key", F.col("partition").cast("bigint").alias("partition"), said["id"].alias("said_id"), said["dt"].alias("said_dt"))


# -- drawn tables -------------------------------------------------------------------------


def _drawn_sql(rows: int) -> str:
    """The drawn feature table in DuckDB's words."""
    number = lambda name: f"('0x' || substr(md5('7:{name}:' || i), 1, 8))::BIGINT"

    def cell(v: float | str) -> str:
        return "'" + v + "'" if isinstance(v, str) else f"'{v!r}'::DOUBLE"

    def one(f) -> str:
        pick = lambda values: f"[{', '.join(map(cell, values))}][1 + {number(f.name + '=')} % {len(values)}]"
        edges, usual = (syn.EDGE_NUMBERS, f"({number(f.name + '=')} % 20000)::DOUBLE / 100.0::DOUBLE") if f.kind == NUMBER else (syn.EDGE_STRINGS, pick(syn.COMMON_STRINGS))
        if f.name == "risk_score":
            edges, usual = [0.0, 99.0], f"({number(f.name + '=')} % 100)::DOUBLE"
        return f"CASE WHEN {number(f.name)} % 1000 < 100 THEN NULL WHEN {number(f.name)} % 1000 < 300 THEN {pick(edges)} ELSE {usual} END AS {f.name}"

    return f"SELECT i + 3000000 AS id, floor(i * (182 * 86400) / {rows}::DOUBLE)::BIGINT + 86400 AS dt, {number('fraud')} % 1000 AS luck, {', '.join(map(one, FIELDS))} FROM (SELECT event_id AS i FROM events)"


#: Rows that half a year of drawn times is laid out for.
_DRAWN_ROWS = 20_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("bigint").alias("_row"))


_RISK = "coalesce(risk_score, 0) / 99.0::DOUBLE"


@query("synthetic_table", f"SELECT id, dt, (luck < 5 + floor(120 * ({_RISK}) * ({_RISK}) * ({_RISK})))::TINYINT AS fraud, {', '.join(f.name for f in FIELDS)} FROM ({_drawn_sql(_DRAWN_ROWS)})")
def _(spark, sf_dir):
    return syn.feature_table(spark, _DRAWN_ROWS, ids=_events(spark, sf_dir)).drop("label_time")


_OVER_DRAWN = [(f"r{i}", r.condition) for i, r in enumerate(q._RULES.rules)]


@query("rules_over_edges", f"SELECT id, {', '.join(f'coalesce({rule_sql(c, samples.SCOPE)}, false) AS {n}' for n, c in _OVER_DRAWN)} FROM ({_drawn_sql(_DRAWN_ROWS)})")
def _(spark, sf_dir):
    """The rules of the sample set over rows with missing and edge values, one drawn for each event."""
    return syn.feature_table(spark, _DRAWN_ROWS, ids=_events(spark, sf_dir)).select("id", *[holds(c, samples.SCOPE).alias(n) for n, c in _OVER_DRAWN])


# -- backtests by label time -----------------------------------------------------------------


def _timed_sql() -> str:
    win = oracle.windowed(q._LABELLED.replace("d.*", "d.*"), q._RULES, "lo", "hi", "hi", q.MATURITY)
    win = win.replace("b AS (SELECT min(dt) AS lo, max(dt) + 1 AS hi FROM d)", "b AS (SELECT min(dt) AS lo, max(dt) + 1 AS hi FROM s)").replace("SELECT d.* EXCLUDE (is_fraud)", "SELECT s.* EXCLUDE (is_fraud)").replace("FROM d, b", "FROM s, b")
    seen = "coalesce(label_time <= hi, false)"
    win = win.replace("AND fraud = 1 AS is_fraud", f"AND fraud = 1 AND {seen} AS is_fraud").replace("AND fraud = 0 AS is_legit", f"AND (fraud = 0 OR fraud = 1 AND NOT {seen}) AS is_legit")
    return q._report_sql("block").replace(q._WINDOW, win)


@query("backtest_label_time", _timed_sql())
def _(spark, sf_dir):
    done = bt.with_simulated_labels(q.decided(spark, sf_dir), q.DELAY)
    return bt.report(done, q._RULES, q._proposed("block"), bt.Options(maturity=q.MATURITY, use_label_time=True))


# the log-normal distribution function with median 5 and sigma 0.5, cut at 20 days
@query("arrived_within", "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.033432418 WHEN 2 THEN 0.5 WHEN 3 THEN 0.917171481 ELSE 0.997219382 END::DOUBLE AS share FROM customer")
def _(spark, sf_dir):
    """How many labels have arrived after some days, which differ by row."""
    df = _customers(spark, sf_dir).withColumn("text", F.expr("CASE id % 6 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN '5' WHEN 3 THEN '10' WHEN 4 THEN '20' ELSE '40' END"))
    return df.select("id", texts.each(df, lambda days: round(q.DELAY.arrived_within(float(days)), 9), "double").alias("share"))


@query("unreachable_rule", f"{q._DECIDED} SELECT r.rule, count(*) FILTER (action = 'block' AND r.rule = 'inside' OR r.rule = 'outside' AND amount > 90) > 0 AND r.rule = 'inside' AS unreachable, r.rule = 'inside' AS has_cover FROM d, (VALUES ('inside'), ('outside')) r(rule) GROUP BY r.rule")
def _(spark, sf_dir):
    """A proposal that repeats a rule in force changes nothing; one that goes beyond it does."""
    rows, rules = [], RuleSet.load("block if :amount: > 60", samples.SCOPE)
    tester = bt.Backtester(q.scored(spark, sf_dir), rules)
    for name, text in (("inside", "block if :amount: > 80"), ("outside", "block if :amount: > 20")):
        out = tester.run(load_rules(text, samples.SCOPE)[0][0], bt.Options(maturity=-1))
        rows.append((name, out["unreachable"], bool(out["covered_by"])))
    tester.close()
    return spark.createDataFrame(rows, "rule string, unreachable boolean, has_cover boolean")


_IDS = "SELECT c_custkey AS id FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")))


def _texts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A rule text for each customer, by an expression that DuckDB reads alike."""
    return _customers(spark, sf_dir).withColumn("text", F.expr(text))


@query("rule_versions", f"SELECT id, CASE id % 3 WHEN 0 THEN '1,2' WHEN 1 THEN '2' ELSE '' END AS live_in FROM ({_IDS})")
def _(spark, sf_dir):
    """In which versions of its own history a customer's shadow rule is live; a version with an error is never added."""

    def live_in(i: str) -> str:
        history = tables.RuleHistory()
        history.add(f"shadow block if :amount: > {i}")
        history.add(f"shadow block if :amount: > {i}.0\nshadow review if :distance: < {i}")
        try:
            history.add(f"block if :amnt: > {i}")
        except RuleError:
            pass
        history.add(f"block if :amount: > {i}")
        asked = (f"shadow block if :amount: > {i}", f"shadow review if :distance: < {i}", f"shadow review if :distance: < {i}5")[int(i) % 3]
        return ",".join(map(str, history.live_in(parse(asked)[0][0].id)))

    df = _texts(spark, sf_dir, "CAST(id AS STRING)")
    return df.select("id", texts.each(df, live_in, "string").alias("live_in"))


# -- the rule language: what is expected is written out by hand, in texts with each customer's number ---------------


@query("rule_words", f"""SELECT id, place, kind, CASE place WHEN 4 THEN id || '.5' ELSE said END AS said FROM ({_IDS}),
 (VALUES (0, 'block', 'block'), (1, 'if', 'if'), (2, 'attr', 'amount'), (3, '>=', '>='), (4, 'number', ''), (5, 'and', 'and'), (6, 'attr', 'device_info'), (7, 'in', 'in'), (8, 'list', 'seen')) w(place, kind, said)""")
def _(spark, sf_dir):
    return texts.words(_texts(spark, sf_dir, "'block if :amount: >= ' || id || '.50 and :device_info: in @seen # why'")).drop("text")


_CANONICAL = {
    "block  if (:amount: > {}) and (:distance: < 2 or true)": "block if :amount: > {} and (:distance: < 2 or true)",
    "shadow review if not (:amount: - (:distance: - {}) = 0.50)": "shadow review if not :amount: - (:distance: - {}) = 0.5",
    "allow if :device_info: not in [\"b{}\", \"a\"]": "allow if not :device_info: in [\"b{}\", \"a\"]",
    "block if ((:amount: + :distance:) * {} > 4)": "block if (:amount: + :distance:) * {} > 4",
}


def _by_kind(sources, column: str = "id") -> str:
    """A CASE by column % n that puts the number into the source of its kind."""
    joined = lambda x: "'" + x.replace("'", "''").replace("{}", f"' || {column} || '") + "'"
    return f"CASE {column} % {len(sources)} " + " ".join(f"WHEN {i} THEN {joined(x)}" for i, x in enumerate(sources)) + " END"


@query("rule_canonical", f"SELECT id, canonical, split_part(canonical, ' if ', 2) AS conditions FROM (SELECT id, {_by_kind(list(_CANONICAL.values()))} AS canonical FROM ({_IDS}))")
def _(spark, sf_dir):
    df = _texts(spark, sf_dir, _by_kind(list(_CANONICAL)))
    said = texts.canonical(df)
    return df.select("id", F.get(said, F.lit(0)).alias("canonical"), F.get(said, F.lit(1)).alias("conditions"))


_WRONG = _by_kind(["block if :amnt: > {}\nallow if :amount: > 2", "allow if :amount: > {}", "allow if :amount: > 1\nreview if :distanc: < {}", "block if :amount: == {}"])
_WHERE = f"SELECT id, CASE id % 4 WHEN 2 THEN 2 ELSE 1 END AS line, CASE id % 4 WHEN 0 THEN 10 WHEN 2 THEN 11 ELSE 19 END AS place, CASE id % 4 WHEN 0 THEN 6 WHEN 2 THEN 9 ELSE 2 END AS width FROM ({_IDS}) WHERE id % 4 <> 1"


@query("rule_problems", f"SELECT id, 'error' AS severity, line, place, width FROM ({_WHERE})")
def _(spark, sf_dir):
    """Where the mistakes of each text are; a good line has none."""
    return texts.diagnosed(_texts(spark, sf_dir, _WRONG), samples.SCOPE).select("id", "severity", "line", "place", "width")


@query("rule_carets", f"SELECT id, repeat(' ', place - 1) || repeat('^', width) AS marks FROM ({_WHERE})")
def _(spark, sf_dir):
    return texts.diagnosed(_texts(spark, sf_dir, _WRONG), samples.SCOPE).select("id", "marks")


@query("rule_suggestions", f"SELECT id, CASE id % 4 WHEN 0 THEN 'amount' WHEN 1 THEN 'card_txn_count_1h' WHEN 2 THEN 'device_info' END AS nearest FROM ({_IDS})")
def _(spark, sf_dir):
    df = _texts(spark, sf_dir, "CASE id % 4 WHEN 0 THEN 'amout' WHEN 1 THEN 'card_txn_count_1hh' WHEN 2 THEN 'devise_info' ELSE 'zzzzzz' || id END")
    return df.select("id", texts.each(df, lambda name: nearest(name, [f.name for f in FIELDS]), "string").alias("nearest"))


@query("rule_warnings", f"SELECT id, 'warning' AS severity, CASE id % 4 WHEN 2 THEN 2 ELSE 1 END AS line FROM ({_IDS}) WHERE id % 4 <> 3")
def _(spark, sf_dir):
    """A chain that can't hold, a condition that always does, a rule said twice, and a text without fault."""
    text = _by_kind(["block if :amount: > 5{} and :amount: < 5", "block if 1 < 2{}", "review if :amount: > {}\nreview if  :amount: > {}.0", "block if :amount: >= 5 and :amount: <= 5{}"])
    return texts.diagnosed(_texts(spark, sf_dir, text), samples.SCOPE).select("id", "severity", "line")


# -- the model ---------------------------------------------------------------------------------


def _parts_sql() -> str:
    """Each feature's contribution as sums of nested CASEs, written from the trees."""
    per: dict[str, list[str]] = {f: [] for f in q._MODEL.features}

    def inside(tree, node: int, feature: str) -> str | None:
        """What paths from this node on add to the feature."""
        if node < 0 or not len(tree.feature):
            return None
        left, right = int(tree.left[node]), int(tree.right[node])
        here = float(tree.inner[node])
        own = q._MODEL.features[tree.feature[node]] == feature
        sides = []
        for child in (left, right):
            step = repr(tree.value(child) - here) + "::DOUBLE" if own else None
            sides.append(" + ".join(x for x in (step, inside(tree, child, feature)) if x) or "0.0::DOUBLE")
        return None if sides == ["0.0::DOUBLE"] * 2 else f"(CASE WHEN {q._MODEL.test_sql(tree, node, 'duckdb')} THEN {sides[0]} ELSE {sides[1]} END)"

    for tree in q._MODEL.trees:
        for f in per:
            said = inside(tree, 0, f)
            per[f] += [said] if said else []
    return ", ".join(f"round({' + '.join(x) or '0.0::DOUBLE'}, 9) AS part_{f}" for f, x in per.items())


_BIAS = sum(float(t.inner[0] if len(t.feature) else t.leaf[0]) for t in q._MODEL.trees)
_PARTS = f"{q._SCORED}, k AS (SELECT id, {_parts_sql()} FROM (SELECT * REPLACE (CASE product_code WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END::DOUBLE AS product_code) FROM t))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.scored(spark, sf_dir, contributions=True)


@query("model_parts", f"{_PARTS} SELECT id, round({_BIAS!r}::DOUBLE, 9) AS bias, {', '.join(f'part_{f}' for f in q._MODEL.features)} FROM k")
def _(spark, sf_dir):
    parts = [F.round(F.get("contributions", F.lit(i)), 9).alias(f"part_{f}") for i, f in enumerate(q._MODEL.features)]
    return _parts(spark, sf_dir).select("id", F.round("bias", 9).alias("bias"), *parts)


def _ranked_sql(by: str, only: str, limit: int) -> str:
    each = " UNION ALL ".join(f"SELECT id, {i} AS i, '{f}' AS f, part_{f} AS c FROM k" for i, f in enumerate(q._MODEL.features))
    return f"{_PARTS}, e AS ({each}), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {by} DESC, i) AS place FROM e WHERE {only}) SELECT k.id, coalesce(string_agg(f, ',' ORDER BY place), '') AS fields FROM k LEFT JOIN o ON o.id = k.id AND place <= {limit} GROUP BY k.id"


@query("model_reasons", _ranked_sql("c", "c > 0", 3))
def _(spark, sf_dir):
    df = _parts(spark, sf_dir).withColumn("contributions", F.transform("contributions", lambda x: F.round(x, 9)))
    return df.select("id", F.array_join(md.top_reasons(F.col("contributions"), q._MODEL.features), ",").alias("fields"))


@query("model_largest", _ranked_sql("abs(c)", "true", 2))
def _(spark, sf_dir):
    df = _parts(spark, sf_dir).withColumn("contributions", F.transform("contributions", lambda x: F.round(x, 9)))
    return df.select("id", F.array_join(F.map_keys(md.largest_contributions(F.col("contributions"), q._MODEL.features, 2)), ",").alias("fields"))


@query("model_uncalibrated", f"{q._SCORED} SELECT id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-raw_score)), 9) AS probability FROM t")
def _(spark, sf_dir):
    return q.scored(spark, sf_dir).select("id", F.round(md.probability(F.col("raw_score"), q._MODEL.sigmoid), 9).alias("probability"))


# -- streams -------------------------------------------------------------------------------------


def _routed_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS rows, count(DISTINCT ({', '.join(oracle._KEYS[e])})) AS keys FROM ({q._P1}) WHERE {' AND '.join(f'({k}) IS NOT NULL' for k in oracle._KEYS[e])}" for e in ENTITIES)


@query("routed_keys", _routed_sql())
def _(spark, sf_dir):
    """What each entity's operator gets: a row for each key that a payment has."""
    return st.routed(q.payments(spark, sf_dir)).filter(F.col("entity") != st.BASE).groupBy("entity").agg(F.count("*").alias("rows"), F.count_distinct("key").alias("keys"))


_FILES, _JITTER, _LATE = 8, 21_600, 17


def _dealt(df: DataFrame, late: bool = False) -> DataFrame:
    """df with the file in which each payment comes: its time's eighth, up to six hours on; with late, one in seventeen two files later."""
    low, high = df.agg(F.min("dt"), F.max("dt")).first()
    place = F.col("dt") - F.lit(low or 0) + F.pmod(F.col("id") * 7_919, F.lit(_JITTER))
    file = F.floor(place / F.lit(((high or 0) - (low or 0) + _JITTER) // _FILES + 1)).cast("int")
    return df.withColumn("file", file + F.when(F.col("id") % _LATE == 0, 2).otherwise(0) if late else file)


_DEALT_SQL = f"SELECT *, floor((dt - min(dt) OVER () + (id * 7919) % {_JITTER}) / ((max(dt) OVER () - min(dt) OVER () + {_JITTER}) // {_FILES} + 1)::DOUBLE)::INT + CASE WHEN id % {_LATE} = 0 THEN 2 ELSE 0 END AS file FROM ({q._P1})"


def arrived(dealt: DataFrame) -> DataFrame:
    """dealt with `batch`, the one in which each payment is taken: the first whose watermark has passed it, or its own file's if that has.

    A batch's watermark is the latest time of all files before it, less the delay.
    """
    seen = dealt.groupBy("file").agg(F.max("dt").alias("high"))
    every = dealt.sparkSession.range(1, _FILES + 3).select(F.col("id").cast("int").alias("batch"))
    marks = every.join(seen, F.col("file") < F.col("batch")).groupBy("batch").agg((F.max("high") - _JITTER).alias("mark"))
    # a dozen rows
    marks = marks.agg(F.array_sort(F.collect_list(F.struct("batch", "mark"))).alias("marks"))
    passed = F.get(F.filter("marks", lambda m: m["mark"] >= F.col("dt")), F.lit(0))["batch"]
    return dealt.crossJoin(F.broadcast(marks)).withColumn("batch", F.greatest(F.col("file"), F.coalesce(passed, F.lit(_FILES + 3)))).drop("marks")


_ARRIVED_SQL = f"""WITH d AS ({_DEALT_SQL}), h AS (SELECT file, max(dt) AS high FROM d GROUP BY file),
m AS (SELECT b AS batch, max(high) - {_JITTER} AS mark FROM range(1, {_FILES + 3}) t(b) JOIN h ON file < b GROUP BY b),
w AS (SELECT d.id, min(batch) AS batch FROM d JOIN m ON mark >= d.dt GROUP BY d.id)
SELECT d.* EXCLUDE (dt, id, file), d.dt, d.dt AS event_dt, d.id AS pid, row_number() OVER (ORDER BY greatest(file, coalesce(batch, {_FILES + 3})), d.dt, d.id) AS id FROM d LEFT JOIN w USING (id)"""


#: Rows of a streamed file; a batch has as many files as its largest part of time asks for.
_FILE_ROWS = 20_000


def _arriving(spark: SparkSession, df: DataFrame, folder: str, beats: tuple[int, ...] = ()) -> DataFrame:
    """Rows (with file) as a stream of JSON files whose batches are their `file`s in order; then a batch for each beat, a time by which the watermark moves.

    Rows of a batch come shuffled, in equally many files for each batch.
    """
    df = stored(df.repartition("file").sortWithinPartitions("file"), folder, "dealt")
    sizes = {r.file: r.n for r in df.groupBy("file").agg(F.count("*").alias("n")).collect()}
    files = -(-max(sizes.values(), default=1) // _FILE_ROWS)
    write = lambda rows: rows.write.mode("append").json(f"{folder}/in")
    for n in sorted(sizes):
        part = df.filter(F.col("file") == n).drop("file")
        mixed = F.xxhash64(*part.columns)
        write(part.repartition(files, mixed).sortWithinPartitions(mixed) if files > 1 else part.coalesce(1).sortWithinPartitions(mixed))
    for beat in beats:
        write(spark.range(0, files, 1, files).select(F.lit(beat).cast("bigint").alias("dt")))
    return spark.readStream.schema(df.drop("file").schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").json(f"{folder}/in")


def live(spark: SparkSession, sf_dir: str, decide=None, columns=None, late: bool = False, half: bool = False) -> tuple[DataFrame, str]:
    """Features of the streamed payments, decided if decide is given, as the stream wrote them; and where its checkpoint is.

    Payments come in eight parts of time, shuffled within six hours. half: those of the first half of time aren't streamed, but are a batch that the stream starts from.
    """
    own, folder = st.session(spark), scratch_dir(spark)
    df, history = _dealt(q.payments(own, sf_dir), late), None
    if half:
        middle = df.agg((F.min("dt") + F.max("dt")).alias("x")).first()[0] or 0
        history, df = df.filter(F.col("dt") < middle // 2).drop("file"), df.filter(F.col("dt") >= middle // 2)
    end = df.agg(F.max("dt")).first()[0] or 0
    # beats let all payments through
    df = st.live_features(_arriving(own, df, folder, (end + 86_400, end + 86_401)), f"{_JITTER} seconds", history=history)
    _done(st.start(df, f"{folder}/out", f"{folder}/checkpoint", decide))
    return spark.read.schema(columns).json(f"{folder}/out"), f"{folder}/checkpoint"


_LIVE = "id bigint, dt bigint, " + ", ".join(f"{c} double" for c in FEATURES)


@query("stream_features", f"{oracle.velocity(q._P1)} SELECT id, dt, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    return live(spark, sf_dir, columns=_LIVE)[0].select("id", "dt", *FEATURES)


_LATE_SQL = f"{oracle.velocity(_ARRIVED_SQL, late=True)} SELECT pid AS id, event_dt AS dt, {oracle.feature_list()} FROM f"


@query("velocity_late", _LATE_SQL)
def _(spark, sf_dir):
    """Features by arrival in a batch, where one payment in seventeen comes days after its time."""
    df = arrived(_dealt(q.payments(spark, sf_dir), late=True))
    return velocity.features_by_arrival(df, ["batch", "dt", "id"]).select("id", "dt", *FEATURES)


@query("stream_late", _LATE_SQL)
def _(spark, sf_dir):
    """The same payments as a stream, which has the late ones behind its watermark."""
    return live(spark, sf_dir, columns=_LIVE, late=True)[0].select("id", "dt", *FEATURES)


@query("stream_from_history", f"{oracle.velocity(q._P1)} SELECT id, dt, {oracle.feature_list()} FROM f WHERE dt >= (SELECT (min(dt) + max(dt)) // 2 FROM f)")
def _(spark, sf_dir):
    """The second half of the payments as a stream that starts from a batch of the first: all have the features of one long history."""
    return live(spark, sf_dir, columns=_LIVE, half=True)[0].select("id", "dt", *FEATURES)


def _kept_sql(entity: str) -> str:
    k = oracle._KEYS[entity]
    latest = f"(SELECT max(dt) FROM ({q._P1})) + 86400 - {_JITTER} - {IDLE_TTL}"
    return f"SELECT '{entity}' AS entity, count(*) AS keys FROM (SELECT max(dt) AS latest FROM ({q._P1}) WHERE {' AND '.join(f'({x}) IS NOT NULL' for x in k)} GROUP BY {', '.join(k)}) WHERE latest > {latest}"


@query("stream_state", " UNION ALL ".join(map(_kept_sql, ENTITIES)))
def _(spark, sf_dir):
    """Key histories in a stopped stream's state: one for each key that wasn't idle for a month by its last watermark."""
    return st.state_summary(spark, live(spark, sf_dir, columns=_LIVE)[1]).filter("entity <> 'waiting'")


@query("stream_decisions", f"{q._DECIDED} SELECT 'txn_' || id AS payment_id, action AS decision, risk_score::BIGINT AS risk_score FROM d")
def _(spark, sf_dir):
    """Score and rules on the stream: the same columns as in batches."""

    def decide(df: DataFrame) -> DataFrame:
        df = md.score(df, q._MODEL, samples.ENCODER, samples.CALIBRATION)
        return records.decisions(ruleset.decide(df, q._RULES), version=1).select("payment_id", "decision", "risk_score")

    return live(spark, sf_dir, decide, "payment_id string, decision string, risk_score bigint")[0]


def _streamed(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    df.repartition(3).write.json(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


@query("stream_once", f"SELECT DISTINCT id FROM ({q._P1})")
def _(spark, sf_dir):
    """Payments of which a third come twice, each let through once."""
    folder, df = scratch_dir(spark), q.payments(spark, sf_dir).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    stream = _streamed(spark, df.unionByName(df.filter("id % 3 = 0")), folder)
    _done(st.start(st.once(stream, "id"), f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.schema("id bigint").json(f"{folder}/out")


_REQUESTS = f"""SELECT id, dt AS "at", 'a' AS body, 'first' AS status, 'a' AS said FROM ({q._P1}) UNION ALL SELECT id, dt + 60, 'a', 'replayed', 'a' FROM ({q._P1}) WHERE id % 3 = 0
 UNION ALL SELECT id, dt + 120, 'b', 'conflict', NULL FROM ({q._P1}) WHERE id % 5 = 0 UNION ALL SELECT id, dt + 86410, 'c', 'first', 'c' FROM ({q._P1}) WHERE id % 7 = 0 UNION ALL SELECT id, dt + 86500, 'c', 'replayed', 'c' FROM ({q._P1}) WHERE id % 14 = 0"""


@query("stored_answers", f"SELECT 'txn_' || id || ':1' AS key, \"at\", status, said || '-' || id AS answer FROM ({_REQUESTS})")
def _(spark, sf_dir):
    """Requests of payments, some of which come again: soon and alike, soon with another body, and a day later, when the first is forgotten."""
    own, folder = st.session(spark), scratch_dir(spark)
    df = q.payments(own, sf_dir).select("id", "dt")
    each = [(0, "a", None), (60, "a", 3), (120, "b", 5), (86_410, "c", 7), (86_500, "c", 14)]
    sent = [F.when(F.lit(True) if n is None else F.col("id") % n == 0, F.struct((F.col("dt") + later).alias("at"), F.lit(body).alias("body"))) for later, body, n in each]
    df = df.select("id", F.inline(F.filter(F.array(*sent), lambda x: x.isNotNull())))
    df = df.select(F.concat(F.lit("txn_"), F.col("id").cast("string"), F.lit(":1")).alias("key"), "at", "body", F.concat("body", F.lit("-"), F.col("id").cast("string")).alias("answer"))
    low, high = df.agg(F.min("at"), F.max("at")).first()
    df = df.withColumn("file", F.floor((F.col("at") - F.lit(low or 0)) / F.lit(((high or 0) - (low or 0)) // 4 + 1)).cast("int"))
    _done(st.start(st.answered(_arriving(own, df, folder)), f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.schema("key string, at bigint, status string, answer string").json(f"{folder}/out")


@query("stream_dead_letters", f"SELECT CASE WHEN id % 40 IN (1, 2, 3, 4) THEN 'dead' ELSE 'good' END AS place, count(*) AS n FROM ({q._P1}) GROUP BY 1")
def _(spark, sf_dir):
    folder = scratch_dir(spark)
    raw = q.payments(spark, sf_dir).select(F.expr(q._BODY.replace("VARCHAR(20)", "STRING")).alias("value"))
    decoded = records.decode_payments(_streamed(spark, raw, folder))
    _done(st.split_dead_letters(decoded, f"{folder}/good", f"{folder}/dead", f"{folder}/checkpoint"))
    count = lambda place: spark.read.parquet(f"{folder}/{place}").agg(F.lit(place).alias("place"), F.count("*").alias("n"))
    return count("good").unionByName(count("dead"))


@query("stream_labels", q._STATES_SQL)
def _(spark, sf_dir):
    """Dispute states merged batch by batch: the last version is what all events at once give."""
    folder = scratch_dir(spark)
    events = q.label_events(spark, sf_dir).select("type", F.col("created").cast("bigint"), "payment_id", "dispute_id", "reason", "status", "amount", F.col("seq").cast("bigint"))
    stream = st.keep_labels(_streamed(spark, events, folder), f"{folder}/states", f"{folder}/checkpoint")
    _done(stream)
    return spark.read.parquet(f"{folder}/states/v{stream.lastProgress['batchId'] if stream.lastProgress['numInputRows'] else stream.lastProgress['batchId'] - 1}")


@query("label_log_replay", q.SQL["payment_labels"])
def _(spark, sf_dir):
    """Labels of a log that was written, read back and gone through again."""
    path = f"{scratch_dir(spark)}/labels"
    events = q.label_events(spark, sf_dir)
    events.write.json(path)
    return labels.payment_labels(labels.dispute_states(spark.read.schema(events.schema).json(path)))

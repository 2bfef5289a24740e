"""The library's registered queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import ENTITIES, FEATURES, FIELDS, WINDOWS
from tidemark.operators import audit, calendar, compare, labels, metrics, ruleset, sketches, training, velocity
from tidemark.operators import backtest as bt
from tidemark.operators import model as md
from tidemark.plans import oracle, samples
from tidemark.plans.checking import ListTable, Scope, load_rules
from tidemark.plans.compiling import column as rule_column
from tidemark.plans.compiling import sql as rule_sql
from tidemark.plans.compiling import with_conditions
from tidemark.plans.language import parse
from tidemark.sources import payments as pay
from tidemark.sources import records, synthetic
from tidemark.streaming import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_P1, _P2 = pay.events_sql(), pay.orders_sql()
_RULES, _MODEL = samples.rules(), samples.model()
#: The test payments span about a month: what is younger than five days is too young.
MATURITY = 5 * bt.DAY
_OPTIONS = bt.Options(maturity=MATURITY)
#: Months of the test payments, which span some 30 days.
MONTH_DAYS = 5


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _calibration_sql(raw: str = "raw_score") -> str:
    c = samples.CALIBRATION
    out = f"CASE WHEN {raw} <= {c.x[0]!r}::DOUBLE THEN {c.y[0]!r}::DOUBLE WHEN {raw} >= {c.x[-1]!r}::DOUBLE THEN {c.y[-1]!r}::DOUBLE"
    for j in range(len(c.x) - 1):
        slope = (c.y[j + 1] - c.y[j]) / (c.x[j + 1] - c.x[j])
        out += f" WHEN {raw} < {c.x[j + 1]!r}::DOUBLE THEN {slope!r}::DOUBLE * ({raw} - ({c.x[j]!r})::DOUBLE) + {c.y[j]!r}::DOUBLE"
    return out + " END"


_SCORED = oracle.scored(_P1, _MODEL.sql("duckdb"), _calibration_sql())
_DECIDED = oracle.decided(_SCORED, _RULES)
_WINDOW = oracle.windowed(_DECIDED, _RULES, "lo", "hi", "hi", MATURITY)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pay.from_events(spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str, contributions: bool = False) -> DataFrame:
    """The test payments with features, score and label columns."""
    df = velocity.features(payments(spark, sf_dir))
    df = md.score(df, _MODEL, samples.ENCODER, samples.CALIBRATION, contributions)
    return df.withColumns({"fraud": F.col("is_fraud"), "label_time": F.lit(None).cast("bigint")})


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleset.decide(scored(spark, sf_dir), _RULES)


# -- sources -----------------------------------------------------------------------


@query("payments_from_events", _P1)
def _(spark, sf_dir):
    return payments(spark, sf_dir)


@query("payments_from_orders", _P2)
def _(spark, sf_dir):
    return pay.from_orders(spark, sf_dir)


@query("order_faults", f"SELECT dt, id, count(*) AS n FROM ({_P1} UNION ALL ({_P1} WHERE event_id % 50 = 0)) GROUP BY dt, id HAVING count(*) > 1")
def _(spark, sf_dir):
    df = payments(spark, sf_dir)
    return pay.order_faults(df.unionByName(df.filter("id % 50 = 0")))


# -- velocity ----------------------------------------------------------------------


@query("velocity_exact", f"{oracle.velocity(_P1)} SELECT id, dt, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    return velocity.features(payments(spark, sf_dir)).select("id", "dt", *FEATURES)


@query("velocity_ties", f"{oracle.velocity(_P2)} SELECT id, dt, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    return velocity.features(pay.from_orders(spark, sf_dir)).select("id", "dt", *FEATURES)


@query("velocity_card", f"{oracle.velocity(_P1, ('card',))} SELECT id, dt, {oracle.feature_list(('card',))} FROM f")
def _(spark, sf_dir):
    return velocity.features(payments(spark, sf_dir), ("card",)).select("id", "dt", *[c for c in FEATURES if c.startswith("card_")])


@query("velocity_bucketed", f"{oracle.velocity(_P1, buckets=velocity.BUCKETS)} SELECT id, dt, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    return velocity.features(payments(spark, sf_dir), buckets=velocity.BUCKETS).select("id", "dt", *FEATURES)


@query("velocity_chunked", f"{oracle.velocity(_P1)} SELECT id, dt, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    return velocity.features(payments(spark, sf_dir), chunks=dict.fromkeys(ENTITIES, 900)).select("id", "dt", *FEATURES)


# a month of payments put into one week, of which one key of each kind has nine of ten
_HOT_WEEK = f"""SELECT * REPLACE (dt % 604800 AS dt, CASE WHEN id % 10 <> 0 THEN 1.0::DOUBLE ELSE card1 END AS card1, CASE WHEN id % 10 <> 0 THEN 2.0::DOUBLE ELSE billing_region END AS billing_region,
 CASE WHEN id % 10 <> 0 THEN floor((dt % 604800) / 86400.0) - 3 ELSE d1 END AS d1, CASE WHEN id % 10 <> 1 THEN 'hot' ELSE device_info END AS device_info, CASE WHEN id % 10 <> 2 THEN 'hot.example' ELSE purchaser_email_domain END AS purchaser_email_domain) FROM ({_P1})"""


def hot_week(df: DataFrame) -> DataFrame:
    dt = F.col("dt") % 604_800
    nine = lambda digit, value, other: F.when(F.col("id") % 10 != digit, value).otherwise(F.col(other))
    changed = {"dt": dt, "card1": nine(0, 1.0, "card1"), "billing_region": nine(0, 2.0, "billing_region"), "d1": nine(0, F.floor(dt / 86_400).cast("double") - 3, "d1"), "device_info": nine(1, "hot", "device_info"), "purchaser_email_domain": nine(2, "hot.example", "purchaser_email_domain")}
    return df.withColumns(changed)


@query("velocity_hot_week", f"{oracle.velocity(_HOT_WEEK)} SELECT id, dt, is_fraud AS fraud, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    """The feature table where one key has most of a week: its payments are summed by minute, as with any number of rows."""
    return velocity.feature_table(hot_week(payments(spark, sf_dir)), rows=1_000).select("id", "dt", "fraud", *FEATURES)


# keys with over fifty rows are hot here, which nearly all devices and domains are
@query("velocity_hot_key", f"{oracle.velocity(_P1)} SELECT id, dt, is_fraud AS fraud, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    return velocity.feature_table(payments(spark, sf_dir), rows=50).select("id", "dt", "fraud", *FEATURES)


_KEYS_SQL = f"""SELECT id, card1 AS card_key, CASE WHEN card1 IS NOT NULL AND billing_region IS NOT NULL AND d1 IS NOT NULL THEN floor(dt / 86400.0) - d1 END AS uid_begun, device_info AS device_key, purchaser_email_domain AS email_key FROM ({_P1})"""


@query("entity_keys", _KEYS_SQL)
def _(spark, sf_dir):
    df = payments(spark, sf_dir)
    k = {e: velocity.keys(e) for e in ENTITIES}
    return df.select("id", k["card"][0].alias("card_key"), k["uid"][2].alias("uid_begun"), k["device"][0].alias("device_key"), k["email"][0].alias("email_key"))


_PROBE_SQL = f"""WITH p AS ({_P1}), q AS (SELECT * FROM p WHERE id % 20 = 0), h AS (SELECT * FROM p WHERE id % 20 <> 0)
SELECT q.id, count(h.id)::DOUBLE AS card_txn_count_24h, coalesce(sum(CAST(round(h.amount * 1000) AS BIGINT)), 0)::DOUBLE / 1000.0::DOUBLE AS card_amount_sum_24h
FROM q LEFT JOIN h ON h.card1 = q.card1 AND (h.dt < q.dt OR h.dt = q.dt AND h.id < q.id) AND h.dt > q.dt - 86400 GROUP BY q.id"""


@query("features_as_of", _PROBE_SQL)
def _(spark, sf_dir):
    df = payments(spark, sf_dir)
    return velocity.as_of(df.filter("id % 20 <> 0"), df.filter("id % 20 = 0")).select("id", "card_txn_count_24h", "card_amount_sum_24h")


# every payment probed against all payments has the features that it has in their history
@query("features_as_of_all", f"{oracle.velocity(_P1)} SELECT id, dt, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    df = payments(spark, sf_dir)
    return velocity.as_of(df, df).select("id", "dt", *FEATURES)


@query("features_as_of_hot_keys", f"{oracle.velocity(_P1)} SELECT id, dt, {oracle.feature_list()} FROM f")
def _(spark, sf_dir):
    df = payments(spark, sf_dir)
    return velocity.as_of(df, df, rows=50).select("id", "dt", *FEATURES)


_FAMILIES = """CASE WHEN feature LIKE '%txn_count%' THEN 'count' WHEN feature LIKE '%amount_sum%' THEN 'sum' WHEN feature LIKE '%mean_amount%' THEN 'mean' WHEN feature LIKE '%amount_ratio%' THEN 'ratio' WHEN feature LIKE '%distinct%' THEN 'distinct' ELSE 'recency' END"""
_EXACT_SELECT = f"(SELECT id, {oracle.feature_list()} FROM ({oracle.velocity(_P1)} SELECT * FROM f))"
_RING_SELECT = f"(SELECT id, {oracle.feature_list()} FROM ({oracle.velocity(_P1, buckets=velocity.BUCKETS)} SELECT * FROM f))"


def _mean_sql(gap: str) -> str:
    """The mean of gaps to the nearest of compare.PARTS to one, by whole numbers: a sum of doubles would leave its last digits to the order of rows."""
    small, large = f"{gap} < {compare.WHOLE!r}::DOUBLE", f"{gap} >= {compare.WHOLE!r}::DOUBLE"
    whole = f"sum(CAST(floor({gap}) AS BIGINT)) FILTER ({small})"
    rest = f"sum(CAST(floor(({gap} - floor({gap})) * {compare.PARTS}::DOUBLE + 0.5::DOUBLE) AS BIGINT)) FILTER ({small})"
    zero = lambda x: f"coalesce(({x})::DOUBLE, 0)"
    return f"({zero(whole)} + {zero(rest)} / {compare.PARTS}::DOUBLE + {zero(f'sum({gap}) FILTER ({large})')}) / nullif(count({gap}), 0)"


def _errors_sql(other: str) -> str:
    return f"""WITH a AS MATERIALIZED {_EXACT_SELECT}, b AS MATERIALIZED {other}, j AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, a.{c} AS x, b.{c} AS y FROM a JOIN b USING (id)" for c in FEATURES)})
SELECT feature, count(*)::BIGINT AS rows, count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS missing_mismatch, count(*) FILTER (x IS NOT DISTINCT FROM y) AS exact, {_mean_sql('abs(y - x)')} AS mean_abs, max(abs(y - x)) AS max_abs,
 {_mean_sql('(CASE WHEN x <> 0 THEN abs(y - x) / abs(x) END)')} AS mean_rel, count(*) FILTER (y > x) AS over, count(*) FILTER (y < x) AS under FROM j GROUP BY feature"""


_ERRORS_SQL = _errors_sql(_RING_SELECT)


def _errors(spark, sf_dir):
    df = payments(spark, sf_dir)
    return compare.feature_errors(velocity.features(df), velocity.features(df, buckets=velocity.BUCKETS), FEATURES)


@query("compare_states", f"SELECT * REPLACE (round(mean_abs, 8) AS mean_abs, round(mean_rel, 8) AS mean_rel) FROM ({_ERRORS_SQL})")
def _(spark, sf_dir):
    return _errors(spark, sf_dir).withColumns({c: F.round(c, 8) for c in ("mean_abs", "mean_rel")})


@query("compare_states_family", f"SELECT {_FAMILIES} AS family, sum(rows)::BIGINT AS rows, sum(missing_mismatch)::BIGINT AS missing_mismatch, sum(exact)::BIGINT AS exact, sum(over)::BIGINT AS over, sum(under)::BIGINT AS under, max(max_abs) AS max_abs FROM ({_ERRORS_SQL}) GROUP BY 1")
def _(spark, sf_dir):
    return compare.by_family(_errors(spark, sf_dir))


# -- expressions -------------------------------------------------------------------

#: One condition for each kind of expression, over the feature table.
EXPRESSIONS = {
    "arithmetic": ":amount: * 2 + :distance: - 3 / :d1_like: > 40",
    "compare_numbers": ":amount: >= 50 and :amount: < 100 and :distance: != 7 and -:amount: <= -50",
    "compare_texts": ':product_code: = "purchase" or :device_type: != "mobile"',
    "compare_columns": ":purchaser_email_domain: = :recipient_email_domain:",
    "division_by_zero": "is_missing(:amount: / (:distance: - :distance:))",
    "in_texts": ":recipient_email_domain: in @trusted_domains",
    "in_numbers": ":billing_region: in [101, 103, -4] or :billing_region: not in [100, 102]",
    "in_nothing": "not (:recipient_email_domain: in @no_domains)",
    "is_missing": "is_missing(:device_info:) or is_missing(:distance: * 2)",
    "lower": 'lower(:purchaser_email_domain:) = "anonymous.com"',
    "starts_with": 'starts_with(:device_info:, "dev") and starts_with(lower(:purchaser_email_domain:), "anon")',
    "three_valued": "not (:distance: > 100 and :billing_region: = 101) or (:distance: <= 100 and true)",
    "constants": "1 < 2 and not false",
}


def _expressions():
    out = {}
    for name, text in EXPRESSIONS.items():
        rules, problems = parse(f"block if {text.replace(':d1_like:', ':billing_country_code:')}")
        assert not problems, problems
        out[name] = rules[0].condition
    return out


_EXPR_SQL = f"""SELECT id, {", ".join(f"{rule_sql(c, samples.SCOPE)} AS {n}" for n, c in _expressions().items())} FROM ({_P1})"""


@query("rule_expressions", _EXPR_SQL)
def _(spark, sf_dir):
    return payments(spark, sf_dir).select("id", *[rule_column(c, samples.SCOPE).alias(n) for n, c in _expressions().items()])


_LONG = {
    "trusted": "allow if :purchaser_email_domain: in @domains", "strange": "block if :purchaser_email_domain: not in @domains and :amount: > 1", "priced": "review if :amount: * 2 in @amounts or lower(:device_info:) in @domains",
}
_DOMAINS_SQL = f"SELECT l_orderkey || '-' || l_linenumber || '.com' AS value FROM lineitem UNION ALL SELECT purchaser_email_domain FROM ({_P1}) WHERE id % 7 = 0"
_AMOUNTS_SQL = f"SELECT o_totalprice::DOUBLE AS value FROM orders UNION ALL SELECT amount * 2 FROM ({_P1}) WHERE id % 5 = 0"


@query("long_lists", f"""WITH p AS ({_P1}), d AS (SELECT DISTINCT value FROM ({_DOMAINS_SQL}) WHERE value IS NOT NULL AND value <> ''), a AS (SELECT DISTINCT value FROM ({_AMOUNTS_SQL}) WHERE value IS NOT NULL)
SELECT id, coalesce(purchaser_email_domain IN (SELECT value FROM d), false) AS trusted, coalesce(purchaser_email_domain NOT IN (SELECT value FROM d) AND amount > 1, false) AS strange,
 coalesce(amount * 2 IN (SELECT value FROM a) OR lower(device_info) IN (SELECT value FROM d), false) AS priced FROM p""")
def _(spark, sf_dir):
    """Rules over a list with a text for each order line and one with a number for each order: values in them, not in them, and missing."""
    df = payments(spark, sf_dir)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    domains = read("lineitem").select(F.concat_ws("", F.concat_ws("-", "l_orderkey", "l_linenumber"), F.lit(".com")).alias("value")).unionByName(df.filter("id % 7 = 0").select(F.col("purchaser_email_domain").alias("value")))
    amounts = read("orders").select(F.col("o_totalprice").cast("double").alias("value")).unionByName(df.filter("id % 5 = 0").select((F.col("amount") * 2).alias("value")))
    scope = Scope(tables={"domains": ListTable(domains, "value"), "amounts": ListTable(amounts, "value")})
    rules = {name: load_rules(text, scope)[0][0].condition for name, text in _LONG.items()}
    return with_conditions(df, rules, scope).select("id", *rules)


# -- rule sets ---------------------------------------------------------------------


@query("decide", f"{_DECIDED} SELECT id, risk_score, rule_index, action, shadows, {', '.join(f'm_{i}' for i in range(len(_RULES.rules)))} FROM d")
def _(spark, sf_dir):
    d = decided(spark, sf_dir)
    return d.select("id", "risk_score", "rule_index", "action", F.array_join("shadow_matches", ",").alias("shadows"), *[f"m_{i}" for i in range(len(_RULES.rules))])


@query("action_counts", f"{_DECIDED} SELECT action, count(*) AS payments, sum({oracle.MILLI})::DOUBLE / 1000.0::DOUBLE AS dollars, count(*) FILTER (fraud = 1) AS fraud FROM d GROUP BY action")
def action_counts(spark, sf_dir):
    d = decided(spark, sf_dir)
    return d.groupBy("action").agg(F.count("*").alias("payments"), (F.sum(bt.thousandths()) / 1000.0).alias("dollars"), F.count_if(F.col("fraud") == 1).alias("fraud"))


@query("flagged", f"{_DECIDED} SELECT id, action IN ('block', 'review') AS flagged FROM d")
def _(spark, sf_dir):
    return ruleset.flagged(decided(spark, sf_dir))


def _stats_sql() -> str:
    rows = []
    for i, r in enumerate(_RULES.rules):
        fm = f"coalesce(sum({oracle.MILLI}) FILTER (m_{i} AND fraud = 1), 0)::DOUBLE / 1000.0::DOUBLE"
        dm = f"coalesce(sum({oracle.MILLI}) FILTER (rule_index = {i} AND fraud = 1), 0)::DOUBLE / 1000.0::DOUBLE"
        m, f = f"count(*) FILTER (m_{i})", f"count(*) FILTER (m_{i} AND fraud = 1)"
        rows.append(f"""SELECT {i} AS rule_index, '{r.id}' AS rule_id, '{"shadow " if r.shadow else ""}{r.action}' AS rule_action, {m} AS matched, {f} AS fraud,
 coalesce({f}::DOUBLE / nullif({m}, 0), 0) AS precision, coalesce({f}::DOUBLE / nullif(count(*) FILTER (fraud = 1), 0), 0) AS fraud_recall,
 coalesce(({m} - {f})::DOUBLE / nullif(count(*) FILTER (fraud <> 1), 0), 0) AS legit_fpr, count(*) FILTER (rule_index = {i}) AS decided, count(*) FILTER (rule_index = {i} AND fraud = 1) AS decided_fraud, {fm} AS fraud_dollars, {dm} AS decided_dollars FROM d""")
    return f"{_DECIDED} " + " UNION ALL ".join(rows)


@query("rule_stats", _stats_sql())
def _(spark, sf_dir):
    return ruleset.rule_stats(decided(spark, sf_dir), _RULES)


_HIT = "action IN ('block', 'review')"


@query("set_stats", f"""{_DECIDED} SELECT count(*)::BIGINT AS rows, count(*) FILTER (fraud = 1) AS frauds, count(*) FILTER ({_HIT}) AS flagged, count(*) FILTER ({_HIT} AND fraud = 1) AS flagged_fraud,
 count(*) FILTER (action = 'allow' AND rule_index >= 0) AS allowed_by_rule, coalesce(count(*) FILTER ({_HIT} AND fraud = 1)::DOUBLE / nullif(count(*) FILTER ({_HIT}), 0), 0) AS precision,
 coalesce(count(*) FILTER ({_HIT} AND fraud = 1)::DOUBLE / nullif(count(*) FILTER (fraud = 1), 0), 0) AS recall, coalesce(count(*) FILTER ({_HIT} AND fraud <> 1)::DOUBLE / nullif(count(*) FILTER (fraud <> 1), 0), 0) AS fpr,
 coalesce(sum({oracle.MILLI}) FILTER ({_HIT} AND fraud = 1)::DOUBLE / nullif(sum({oracle.MILLI}) FILTER (fraud = 1), 0), 0) AS fraud_dollar_recall,
 coalesce(sum({oracle.MILLI}) FILTER ({_HIT} AND fraud <> 1)::DOUBLE / nullif(sum({oracle.MILLI}) FILTER (fraud <> 1), 0), 0) AS legit_dollar_share FROM d""")  # fmt: skip
def _(spark, sf_dir):
    return ruleset.set_stats(decided(spark, sf_dir))


# -- backtests ---------------------------------------------------------------------

_CHANGES = {"allow": "(blocked OR reviewed)", "block": "(NOT allowed AND NOT blocked)", "review": "(NOT allowed AND NOT blocked AND NOT reviewed)"}


def _proposed(action: str):
    from tidemark.plans.checking import load_rules

    return load_rules(samples.PROPOSED[action], samples.SCOPE)[0][0]


def _proposal_sql(action: str) -> str:
    rule = _proposed(action)
    return _WINDOW + f""",
x AS (SELECT *, counted AND coalesce({rule_sql(rule.condition, samples.SCOPE)}, false) AS matched FROM w),
y AS (SELECT *, matched AND {_CHANGES[action]} AS changed FROM x)"""


def _report_sql(action: str) -> str:
    groups = {"period": "counted", "immature": "immature", "matched": "matched", "changed": "changed"}
    groups |= {"allow": {"overrides_block": "changed AND blocked", "overrides_review": "changed AND reviewed"}, "block": {"from_review": "changed AND reviewed"}, "review": {}}[action]
    money = lambda c: f"coalesce(sum(milli) FILTER ({c}), 0)::DOUBLE"
    count = lambda c: f"count(*) FILTER ({c})"
    rows = []
    for g, c in groups.items():
        f, li = f"{c} AND is_fraud", f"{c} AND is_legit"
        other = f"{c} AND NOT is_fraud AND NOT is_legit"
        rows.append(f"""SELECT '{g}' AS grp, {count(c)} AS payments, {money(c)} / 1000.0::DOUBLE AS dollars, {count(f)} AS fraud, {money(f)} / 1000.0::DOUBLE AS fraud_dollars, {count(li)} AS legit, {money(li)} / 1000.0::DOUBLE AS legit_dollars,
 {count(other)} AS unlabeled, {money(other)} / 1000.0::DOUBLE AS unlabeled_dollars, {count(f)}::DOUBLE / nullif({count(f)} + {count(li)}, 0) AS precision,
 {money(f)} / nullif({money("is_fraud")}, 0) AS fraud_dollar_share, {count(f)}::DOUBLE / nullif({count("is_fraud")}, 0) AS fraud_count_share FROM y""")
    return _proposal_sql(action) + " " + " UNION ALL ".join(rows)


_BOTH = '"both"'  # a reserved word there


def _overlaps_sql(action: str) -> str:
    rows = [f"SELECT {i} AS rule_index, '{r.id}' AS rule_id, '{r.action}' AS rule_action, count(*) FILTER (m_{i}) AS {_BOTH}, count(*) FILTER (m_{i})::DOUBLE / nullif(count(*), 0) AS share, count(*) FILTER (rule_index = {i}) AS decided_by FROM y WHERE matched" for i, r in _RULES.live()]
    return f"{_proposal_sql(action)} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE {_BOTH} > 0"


def _samples_sql(action: str) -> str:
    from tidemark.plans.language import attributes

    fields = list(dict.fromkeys([*attributes(_proposed(action).condition), *bt.SAMPLE_FIELDS]))
    return _proposal_sql(action) + f""",
z AS (SELECT *, row_number() OVER (ORDER BY dt, id) - 1 AS place, count(*) OVER () AS n FROM y WHERE CASE WHEN (SELECT bool_or(changed) FROM y) THEN changed ELSE matched END),
k AS (SELECT DISTINCT (j * n) // least(10, n) AS place FROM z, range(10) r(j) WHERE j < least(10, n))
SELECT id, dt, CASE WHEN is_fraud THEN 'fraud' WHEN is_legit THEN 'legit' ELSE 'unknown' END AS label, action AS current, CASE WHEN changed THEN '{action}' ELSE action END AS proposed, {", ".join(fields)} FROM z JOIN k USING (place)"""


def _register_backtests() -> None:
    for action in samples.PROPOSED:
        rule = _proposed(action)
        query(f"backtest_{action}", _report_sql(action))(lambda s, d, r=rule: bt.report(decided(s, d), _RULES, r, _OPTIONS))
        query(f"overlaps_{action}", _overlaps_sql(action))(lambda s, d, r=rule: bt.overlaps(decided(s, d), _RULES, r, _OPTIONS))
        query(f"samples_{action}", _samples_sql(action))(lambda s, d, r=rule: bt.samples(decided(s, d), _RULES, r, _OPTIONS))


_register_backtests()


def _sweep_sql(given: bool) -> str:
    money = lambda c: f"coalesce(sum(milli) FILTER ({c}), 0)::DOUBLE"
    at = f"counted {'AND NOT allowed' if given else ''} AND risk_score >= k"
    return _WINDOW + f"""
SELECT k::INT AS threshold, count(*) FILTER ({at}) AS payments, {money(at)} / 1000.0::DOUBLE AS dollars, count(*) FILTER ({at} AND is_fraud) AS fraud, {money(at + " AND is_fraud")} / 1000.0::DOUBLE AS fraud_dollars,
 count(*) FILTER ({at} AND is_legit) AS legit, {money(at + " AND is_legit")} / 1000.0::DOUBLE AS legit_dollars,
 count(*) FILTER ({at} AND is_fraud)::DOUBLE / nullif(count(*) FILTER ({at} AND is_fraud) + count(*) FILTER ({at} AND is_legit), 0) AS precision,
 {money(at + " AND is_fraud")} / nullif({money("is_fraud")}, 0) AS fraud_dollar_recall, count(*) FILTER ({at} AND is_fraud)::DOUBLE / nullif(count(*) FILTER (is_fraud), 0) AS fraud_count_recall
FROM w, range(100) r(k) GROUP BY k"""


@query("sweep", _sweep_sql(False))
def _(spark, sf_dir):
    return bt.sweep(decided(spark, sf_dir), _RULES, _OPTIONS)


@query("sweep_given_current", _sweep_sql(True))
def _(spark, sf_dir):
    return bt.sweep(decided(spark, sf_dir), _RULES, _OPTIONS, given_current=True)


@query("sweep_totals", f"""{_WINDOW} SELECT count(*) FILTER (allowed) AS protected, coalesce(sum(milli) FILTER (allowed), 0)::DOUBLE / 1000.0::DOUBLE AS protected_dollars,
 count(*) FILTER (risk_score IS NULL) AS unscored, coalesce(sum(milli) FILTER (risk_score IS NULL), 0)::DOUBLE / 1000.0::DOUBLE AS unscored_dollars FROM w WHERE counted""")  # fmt: skip
def _(spark, sf_dir):
    return bt.sweep_totals(decided(spark, sf_dir), _RULES, _OPTIONS)




#: splitmix64 and Box-Muller in 128-bit integers.
_DELAY_SQL = """
s0 AS (SELECT *, xor(1::UHUGEINT, (id::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) AS x0 FROM d),
s1 AS (SELECT *, (x0 + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS x1, (x0 + 2 * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS x2 FROM s0),
s2 AS (SELECT *, (xor(x1, x1 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS y1, (xor(x2, x2 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS y2 FROM s1),
s3 AS (SELECT *, (xor(y1, y1 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z1, (xor(y2, y2 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z2 FROM s2),
s4 AS (SELECT *, ((xor(z1, z1 // 2147483648::UHUGEINT) // 2048::UHUGEINT)::DOUBLE + 0.5::DOUBLE) / 9007199254740992::DOUBLE AS u1, (xor(z2, z2 // 2147483648::UHUGEINT) // 2048::UHUGEINT)::DOUBLE / 9007199254740992::DOUBLE AS u2 FROM s3),
s5 AS (SELECT *, {median}::DOUBLE * exp(0.5::DOUBLE * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)) AS days FROM s4),
s AS (SELECT * EXCLUDE (x0, x1, x2, y1, y2, z1, z2, u1, u2), CASE WHEN fraud = 1 AND days <= {cap} THEN dt + round(days * 86400)::BIGINT END AS label_time FROM s5)"""
#: Days suit the month that the test payments span.
DELAY = bt.Delay(median_days=5.0, max_days=20.0)
_LABELLED = _DECIDED + "," + _DELAY_SQL.format(median=5, cap=20)


@query("label_times", f"{_LABELLED} SELECT id, label_time FROM s")
def _(spark, sf_dir):
    return bt.with_simulated_labels(decided(spark, sf_dir), DELAY).select("id", "label_time")


def _delay_query_sql() -> str:
    rule = _proposed("block")
    allowed = " OR ".join(f"m_{i}" for i, r in _RULES.live() if r.action == "allow")
    head = _LABELLED + f""",
h AS (SELECT *, {oracle.MILLI} AS milli, coalesce({rule_sql(rule.condition, samples.SCOPE)}, false) AND NOT ({allowed}) AND action <> 'block' AS hit, (SELECT max(dt) + 1 FROM d) AS now FROM s),"""
    win, mat = 10 * bt.DAY, MATURITY
    views = {"naive": (f"now - {win}", "now", True), "naive_truth": (f"now - {win}", "now", False), "matured": (f"now - {mat} - {win}", f"now - {mat}", True), "matured_truth": (f"now - {mat} - {win}", f"now - {mat}", False)}
    rows = []
    for v, (a, b, timed) in views.items():
        seen = "coalesce(label_time <= now, false)"
        f = f"(fraud = 1 AND {seen})" if timed else "(fraud = 1)"
        li = f"(fraud = 0 OR (fraud = 1 AND NOT {seen}))" if timed else "(fraud = 0)"
        i = f"dt >= {a} AND dt < {b}"
        rows.append(f"""SELECT '{v}' AS view, max({a})::BIGINT AS start, max({b})::BIGINT AS end_, count(*) FILTER ({i} AND hit) AS changed, coalesce(sum(milli) FILTER ({i} AND hit), 0)::DOUBLE / 1000.0::DOUBLE AS changed_dollars,
 count(*) FILTER ({i} AND hit AND {f}) AS caught, coalesce(sum(milli) FILTER ({i} AND hit AND {f}), 0)::DOUBLE / 1000.0::DOUBLE AS caught_dollars,
 count(*) FILTER ({i} AND hit AND {f})::DOUBLE / nullif(count(*) FILTER ({i} AND hit AND ({f} OR {li})), 0) AS precision,
 coalesce(sum(milli) FILTER ({i} AND hit AND {f}), 0)::DOUBLE / nullif(coalesce(sum(milli) FILTER ({i} AND {f}), 0)::DOUBLE, 0) AS fraud_dollar_share FROM h""")
    return head + f"""
v AS ({" UNION ALL ".join(rows)})
SELECT v.*, CASE WHEN v.view NOT LIKE '%truth' THEN 1.0::DOUBLE - v.caught_dollars / nullif(t.caught_dollars, 0) END AS understatement FROM v LEFT JOIN v t ON t.view = v.view || '_truth'"""


@query("label_delay", _delay_query_sql())
def _(spark, sf_dir):
    d = bt.with_simulated_labels(decided(spark, sf_dir), DELAY)
    now = payments(spark, sf_dir).agg(F.max("dt") + 1).first()[0]
    return bt.label_delay(d, _RULES, _proposed("block"), now, 10 * bt.DAY, MATURITY)


# -- model and metrics ---------------------------------------------------------------


@query("model_score", f"{_SCORED} SELECT id, raw_score, probability, risk_score FROM t")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "raw_score", "probability", "risk_score")


@query("model_contributions")
def _(spark, sf_dir):
    d = scored(spark, sf_dir, contributions=True)
    return d.select("id", "raw_score", "bias", "contributions", md.top_reasons(F.col("contributions"), _MODEL.features).alias("reasons"))


@query("risk_histogram", f"{_SCORED} SELECT risk_score, count(*) AS n FROM t GROUP BY risk_score")
def _(spark, sf_dir):
    return metrics.score_histogram(scored(spark, sf_dir))


_GROUPS = f"""{_SCORED}, g AS (SELECT raw_score AS s, count(*) FILTER (fraud = 1) AS p, count(*) FILTER (fraud = 0) AS n, sum(CASE WHEN fraud = 1 THEN {oracle.MILLI} ELSE 0 END) AS pm, sum(CASE WHEN fraud = 0 THEN {oracle.MILLI} ELSE 0 END) AS nm FROM t WHERE fraud IN (0, 1) GROUP BY 1),
c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(pm) OVER (ORDER BY s DESC) AS cpm, sum(nm) OVER (ORDER BY s DESC) AS cnm, sum(p) OVER () AS tp, sum(n) OVER () AS tn, sum(pm) OVER () AS tpm, sum(nm) OVER () AS tnm FROM g)"""


@query("ranking_metrics", f"""{_GROUPS} SELECT sum(n::DOUBLE * (2 * cp - p)) / (2.0::DOUBLE * max(tp) * max(tn)) AS roc_auc, round(sum(p::DOUBLE / tp * cp / (cp + cn)), 9) AS average_precision,
 min(s) FILTER (cn <= 0.01::DOUBLE * tn) AS threshold, coalesce(max(cp) FILTER (cn <= 0.01::DOUBLE * tn), 0)::DOUBLE / max(tp) AS recall, coalesce(max(cn) FILTER (cn <= 0.01::DOUBLE * tn), 0)::DOUBLE / max(tn) AS fpr FROM c""")  # fmt: skip
def _(spark, sf_dir):
    return metrics.ranking(scored(spark, sf_dir), "raw_score").withColumn("average_precision", F.round("average_precision", 9)).withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@query("dollar_budget", f"""{_GROUPS} SELECT coalesce(min(s) FILTER (cnm <= 0.05::DOUBLE * tnm), 'infinity'::DOUBLE) AS threshold, coalesce(max(cpm) FILTER (cnm <= 0.05::DOUBLE * tnm), 0)::DOUBLE / max(tpm) AS fraud_dollar_recall,
 coalesce(max(cnm) FILTER (cnm <= 0.05::DOUBLE * tnm), 0)::DOUBLE / max(tnm) AS legit_dollar_share FROM c""")  # fmt: skip
def _(spark, sf_dir):
    return metrics.dollar_budget(scored(spark, sf_dir), "raw_score", budget=0.05)


@query("at_threshold", f"{_GROUPS} SELECT sum(p) FILTER (s >= -2.0)::DOUBLE / sum(p) AS recall, sum(n) FILTER (s >= -2.0)::DOUBLE / sum(n) AS fpr, sum(pm) FILTER (s >= -2.0)::DOUBLE / sum(pm) AS fraud_dollar_recall, sum(nm) FILTER (s >= -2.0)::DOUBLE / sum(nm) AS legit_dollar_share FROM g")
def _(spark, sf_dir):
    return metrics.at_threshold(scored(spark, sf_dir), -2.0, "raw_score")


@query("brier", f"{_SCORED} SELECT round(avg((probability - fraud) ** 2), 9) AS brier FROM t WHERE fraud IN (0, 1)")
def _(spark, sf_dir):
    return metrics.brier(scored(spark, sf_dir), "probability").select(F.round("brier", 9).alias("brier"))


_BINS = f"{_SCORED} SELECT least(floor(probability * 10), 9)::INT AS bin, count(*) AS n, round(avg(probability), 9) AS mean_p, round(avg(fraud::DOUBLE), 9) AS rate FROM t WHERE fraud IN (0, 1) GROUP BY 1"


@query("reliability", _BINS)
def _(spark, sf_dir):
    b = metrics.reliability(scored(spark, sf_dir), "probability")
    return b.select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


@query("calibration_error", f"SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM ({_BINS})")
def _(spark, sf_dir):
    return metrics.calibration_error(metrics.reliability(scored(spark, sf_dir), "probability")).select(F.round("ece", 6).alias("ece"))


@query("reliability_by_mass", f"{_SCORED} SELECT (b - 1)::INT AS bin, count(*) AS n, round(avg(probability), 9) AS mean_p, round(avg(fraud::DOUBLE), 9) AS rate FROM (SELECT *, ntile(20) OVER (ORDER BY probability, id) AS b FROM t WHERE fraud IN (0, 1)) GROUP BY b")
def _(spark, sf_dir):
    b = metrics.reliability_by_mass(scored(spark, sf_dir), "probability")
    return b.select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


_MEDIANS = ("amount", "distance", "card_txn_count_24h")


@query("medians", f"{_SCORED}" + " UNION ALL ".join(f" SELECT '{c}' AS field, median({c}) AS p50 FROM t" for c in _MEDIANS))
def _(spark, sf_dir):
    return metrics.medians(scored(spark, sf_dir), list(_MEDIANS))


_MONTH = f"least(greatest(floor((dt - (SELECT min(dt) // 86400 * 86400 FROM p)) / ({MONTH_DAYS} * 86400.0)), 0), 5)"
_SPLIT = f"CASE WHEN {_MONTH} <= 3 THEN 'train' WHEN {_MONTH} = 4 THEN 'valid' ELSE 'test' END"


@query("split_counts", f'WITH p AS ({_P1}) SELECT {_SPLIT} AS split, count(*) AS "rows", count(*) FILTER (is_fraud = 1) AS fraud FROM p GROUP BY 1')
def _(spark, sf_dir):
    return calendar.split_counts(payments(spark, sf_dir).withColumn("fraud", F.col("is_fraud")), MONTH_DAYS)


_ENCODED = ("product_code", "purchaser_email_domain", "device_info")


@query("encoded", f"WITH p AS ({_P1}), q AS (SELECT *, {_SPLIT} AS split FROM p), " + ", ".join(f"e_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM q WHERE split = 'train' AND {c} IS NOT NULL))" for c in _ENCODED) + " SELECT id, " + ", ".join(f"e_{c}.code::DOUBLE AS {c}" for c in _ENCODED) + " FROM q " + " ".join(f"LEFT JOIN e_{c} ON q.{c} = e_{c}.v" for c in _ENCODED))
def _(spark, sf_dir):
    df = payments(spark, sf_dir)
    train = df.filter(calendar.split(calendar.first_day(df), MONTH_DAYS) == "train")
    return md.encode(df, md.fit_encoder(train, _ENCODED)).select("id", *_ENCODED)


# -- physical questions ---------------------------------------------------------------


@query("key_skew", f"WITH p AS ({_P1}), c AS (SELECT (card1 % 8)::INT AS part, count(*) AS events FROM p WHERE card1 IS NOT NULL GROUP BY 1) SELECT part, events, events / (SELECT sum(events)::DOUBLE / 8 FROM c) AS share_of_mean FROM c")
def _(spark, sf_dir):
    return compare.key_skew(payments(spark, sf_dir), "card1", 8, F.col("card1") % 8)


@query("top_keys", f"SELECT device_info, count(*) AS events FROM ({_P1}) WHERE device_info IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf_dir):
    return compare.top_keys(payments(spark, sf_dir), "device_info")


_LOCKSTEP = [f"email_txn_count_{w}" for w in WINDOWS]


def _control_sql() -> str:
    parted = f"SELECT * REPLACE (purchaser_email_domain || '/' || CAST(CAST(card1 AS BIGINT) % 5 AS VARCHAR) AS purchaser_email_domain) FROM ({_P1})"
    pick = lambda source: f"(SELECT id, {', '.join(_LOCKSTEP)} FROM ({oracle.velocity(source, ('email',))} SELECT * FROM f))"
    differs = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _LOCKSTEP)
    return f'SELECT count(*) AS "rows", count(*) FILTER ({differs}) AS wrong_rows FROM {pick(_P1)} a JOIN {pick(parted)} b USING (id)'


@query("partition_control", _control_sql())
def _(spark, sf_dir):
    df = payments(spark, sf_dir)
    parted = df.withColumn("purchaser_email_domain", F.concat("purchaser_email_domain", F.lit("/"), (F.col("card1") % 5).cast("string")))
    return compare.order_control(velocity.features(df, ("email",)), velocity.features(parted, ("email",)), _LOCKSTEP)


# -- sketches --------------------------------------------------------------------------


@query("sketch_counts", f"{oracle.sketched(_P1, ('card',))} SELECT id, " + ", ".join(f"n{w} AS card_txn_count_{w}, s{w} AS card_amount_sum_{w}" for w in WINDOWS) + " FROM cardm")
def _(spark, sf_dir):
    return sketches.count_min(payments(spark, sf_dir), "card").drop("dt")


_SKETCHED = oracle.sketched(_P1)


@query("sketch_features", f"{_SKETCHED} SELECT id, {oracle.feature_list()} FROM k")
def _(spark, sf_dir):
    return sketches.features(payments(spark, sf_dir)).select("id", *FEATURES)


@query("compare_sketches", "SELECT * REPLACE (round(mean_abs, 8) AS mean_abs, round(mean_rel, 8) AS mean_rel) FROM (" + _errors_sql(f"(SELECT id, {oracle.feature_list()} FROM ({_SKETCHED} SELECT * FROM k))") + ")")
def _(spark, sf_dir):
    # what the features are made of: hot keys' rows are stored with all their columns
    df = payments(spark, sf_dir).select("id", "dt", "amount", "card1", "billing_region", "d1", "device_info", "purchaser_email_domain")
    errors = compare.feature_errors(velocity.features(df), sketches.features(df), FEATURES)
    return errors.withColumns({c: F.round(c, 8) for c in ("mean_abs", "mean_rel")})


_NUMBER = "('0x' || substr(md5('{}|' || (round(card1 * 1000)::BIGINT)::VARCHAR), 1, 8))::BIGINT"
_M = 1 << sketches.LG_K


@query("sketch_distinct_cards", f"""WITH p AS (SELECT device_info AS key, floor(dt / 3600.0)::BIGINT AS hour, card1 FROM ({_P1}) WHERE device_info IS NOT NULL),
r AS (SELECT key, hour, {_NUMBER.format('r')} % {_M} AS register, max(CASE WHEN {_NUMBER.format('h')} = 0 THEN 33 ELSE 33 - length(bin({_NUMBER.format('h')})) END) AS rank FROM p WHERE card1 IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT key, hour FROM p),
g AS (SELECT a.key, a.hour, register, max(rank) AS rank FROM a JOIN r ON a.key = r.key AND r.hour BETWEEN a.hour - {sketches.DAY_HOURS} AND a.hour - 1 GROUP BY 1, 2, 3),
e AS (SELECT key, hour, count(*) AS n, sum(pow(2.0::DOUBLE, -rank)) AS s FROM g GROUP BY 1, 2),
c AS (SELECT key, hour, n, {0.7213 / (1 + 1.079 / _M) * _M * _M!r}::DOUBLE / (s + ({_M} - n)) AS raw FROM e)
SELECT key, hour, coalesce(CASE WHEN raw <= {2.5 * _M} AND n < {_M} THEN round({_M} * ln({_M}::DOUBLE / ({_M} - n)::DOUBLE)) ELSE round(raw) END, 0)::BIGINT AS cards FROM a LEFT JOIN c USING (key, hour)""")
def _(spark, sf_dir):
    return sketches.distinct_by_hour(payments(spark, sf_dir), "device")


# -- training ---------------------------------------------------------------------------


@query("trained_model", f"SELECT count(*) AS rows, count(*) AS scored, count(*) AS explained FROM ({_P1})")
def _(spark, sf_dir):
    """Boosted trees trained here, written and read as a model file, score every payment and explain each score."""
    df, numbers = payments(spark, sf_dir), ["amount", "distance", "billing_region"]
    trained, _ = training.boosted(df.filter("id % 5 <> 0"), df.filter("id % 5 = 0"), numbers, "is_fraud", grid=({"maxDepth": 3, "stepSize": 0.1},), rounds=5)
    out = md.score(df, md.parse_model(md.model_text(trained)), {}, samples.CALIBRATION, contributions=True)
    parts = F.aggregate("contributions", F.col("bias"), lambda total, x: total + x)
    return out.agg(F.count("*").alias("rows"), F.count("raw_score").alias("scored"), F.count_if(F.abs(F.col("raw_score") - parts) < 1e-9).alias("explained"))


# -- labels -------------------------------------------------------------------------------

_EVENTS_SQL = f"""
SELECT 'evt_' || id AS event_id, CASE WHEN id % 7 < 4 THEN 'payment_intent.succeeded' WHEN id % 7 = 6 THEN 'charge.dispute.closed' ELSE 'charge.dispute.created' END AS type,
 dt + {pay.EPOCH} + (id % 4) * 1000 AS created, CASE WHEN id % 3 = 0 THEN 'txn_' ELSE 'pi_' END || (id % 97) AS payment_id, CASE WHEN id % 7 >= 4 THEN 'dp_' || (id % 97) || '_' || (id % 2) END AS dispute_id,
 CASE WHEN id % 5 = 0 THEN 'duplicate' ELSE 'fraudulent' END AS reason, CASE WHEN id % 7 = 6 THEN (CASE WHEN id % 2 = 0 THEN 'won' ELSE 'lost' END) ELSE 'needs_response' END AS status, CAST(round(amount * 100) AS BIGINT) AS amount, id AS seq
FROM {{payments}}"""
_EV = _EVENTS_SQL.format(payments=f"({_P1})")
_STATES_SQL = f"""SELECT payment_id, dispute_id, arg_max(reason, k) AS reason, arg_max(status, k) AS status, arg_max(amount, k) AS amount, arg_max(created, k) AS updated, bool_or(type = 'charge.dispute.closed') AS closed
FROM (SELECT *, created::HUGEINT * 1000000000000 + (CASE WHEN type = 'charge.dispute.closed' THEN 1 ELSE 0 END) * 100000000000 + seq AS k FROM ({_EV}) WHERE type <> 'payment_intent.succeeded') GROUP BY 1, 2"""
_LABELS_SQL = f"""SELECT payment_id, (CASE WHEN bool_or(reason = 'fraudulent' AND NOT (closed AND status = 'won')) THEN 1 WHEN bool_or(reason = 'fraudulent') THEN 0 ELSE -1 END)::TINYINT AS label FROM ({_STATES_SQL}) GROUP BY 1"""


def label_events(spark, sf_dir):
    """Label events made from the test payments."""
    return spark.sql(_EVENTS_SQL.format(payments="{p}"), p=payments(spark, sf_dir))


@query("dispute_states", _STATES_SQL)
def _(spark, sf_dir):
    return labels.dispute_states(label_events(spark, sf_dir))


@query("dispute_upsert", _STATES_SQL)
def _(spark, sf_dir):
    events = label_events(spark, sf_dir)
    return labels.upsert(labels.dispute_states(events.filter("seq % 3 = 0")), events.filter("seq % 3 <> 0"))


@query("payment_labels", _LABELS_SQL)
def _(spark, sf_dir):
    return labels.payment_labels(labels.dispute_states(label_events(spark, sf_dir)))


@query("label_counts", f"""WITH s AS ({_STATES_SQL}), l AS ({_LABELS_SQL}), e AS (SELECT payment_id, bool_or(type = 'payment_intent.succeeded') AS ok FROM ({_EV}) GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS payments, (SELECT count(*) FROM e WHERE ok) AS succeeded, (SELECT count(*) FROM l WHERE label = 1) AS fraud, (SELECT count(*) FROM l WHERE label = 0) AS legit, (SELECT count(*) FROM s) AS disputes, (SELECT count(*) FROM s WHERE closed) AS closed_disputes""")  # fmt: skip
def _(spark, sf_dir):
    return labels.label_counts(label_events(spark, sf_dir))


@query("label_overlay", f"WITH p AS ({_P1}), l AS ({_LABELS_SQL}) SELECT id, dt, coalesce(CASE WHEN label <> -1 THEN label END, is_fraud)::TINYINT AS fraud FROM p LEFT JOIN l ON l.payment_id = 'txn_' || p.id")
def _(spark, sf_dir):
    table = payments(spark, sf_dir).select("id", "dt", F.col("is_fraud").alias("fraud"))
    return labels.overlay(table, labels.payment_labels(labels.dispute_states(label_events(spark, sf_dir))))


_FIRST_SQL = f"SELECT payment_id, min(created) - {pay.EPOCH} AS arrived_dt FROM ({_EV}) WHERE type = 'charge.dispute.created' AND reason = 'fraudulent' GROUP BY 1"


@query("first_disputes", _FIRST_SQL)
def _(spark, sf_dir):
    return labels.first_disputes(label_events(spark, sf_dir))


@query("labels_by_disputes", f"WITH p AS ({_P1}), f AS ({_FIRST_SQL}) SELECT id, dt, (arrived_dt IS NOT NULL)::TINYINT AS fraud, arrived_dt AS label_time FROM p LEFT JOIN f ON f.payment_id = 'txn_' || p.id")
def _(spark, sf_dir):
    table = payments(spark, sf_dir).select("id", "dt", F.col("is_fraud").alias("fraud"), F.lit(None).cast("bigint").alias("label_time"))
    return labels.label_by_disputes(table, labels.first_disputes(label_events(spark, sf_dir)))


# -- records --------------------------------------------------------------------------------

_BODY = """CASE WHEN id % 40 = 1 THEN 'not json' WHEN id % 40 = 2 THEN '{"payment_id": "", "created": 5}'
 WHEN id % 40 = 3 THEN '{"payment_id": "txn_' || CAST(id AS VARCHAR(20)) || '", "created": ' || CAST(dt + 1512086400 AS VARCHAR(20)) || ', "risk_fields": {"card_1": 7}}'
 WHEN id % 40 = 4 THEN '{"payment_id": "txn_' || CAST(id AS VARCHAR(20)) || '", "created": ' || CAST(dt + 1512086400 AS VARCHAR(20)) || ', "risk_fields": {"card1": "7"}}'
 ELSE '{"payment_id": "txn_' || CAST(id AS VARCHAR(20)) || '", "created": ' || CAST(dt + 1512086400 AS VARCHAR(20)) || ', "amount": ' || CAST(id % 1000 AS VARCHAR(20)) || ', "risk_fields": {"card1": ' || CAST(id % 50 AS VARCHAR(20)) || ', "card4": ""}}' END"""


@query("decoded_payments", f"""SELECT CASE WHEN id % 40 IN (1, 2, 3, 4) THEN CASE id % 40 WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'payment_id is missing' WHEN 3 THEN 'unknown risk_fields: card_1' ELSE 'risk_fields.card1 is not a number' END END AS error,
 CASE WHEN id % 40 NOT IN (1, 2, 3, 4) THEN id END AS id, CASE WHEN id % 40 NOT IN (1, 2, 3, 4) THEN dt END AS dt, CASE WHEN id % 40 NOT IN (1, 2, 3, 4) THEN (id % 1000)::DOUBLE / 100.0::DOUBLE END AS amount, CASE WHEN id % 40 NOT IN (1, 2, 3, 4) THEN (id % 50)::DOUBLE END AS card1 FROM ({_P1})""")  # fmt: skip
def _(spark, sf_dir):
    raw = payments(spark, sf_dir).select(F.expr(_BODY.replace("VARCHAR(20)", "STRING")).alias("value"))
    d = records.decode_payments(raw)
    ok = F.col("error").isNull()
    return d.select("error", *[F.when(ok, F.col(c)).alias(c) for c in ("id", "dt", "amount", "card1")])


def logged(spark, sf_dir):
    return records.decisions(decided(spark, sf_dir), version=1, model_sha256="m1")


@query("decision_records", f"{_DECIDED} SELECT 'txn_' || id AS payment_id, dt + {pay.EPOCH} AS created, action AS decision, risk_score::BIGINT AS risk_score, len(string_split(shadows, ',')) * (shadows <> '')::INT AS n_shadow FROM d")
def _(spark, sf_dir):
    return logged(spark, sf_dir).select("payment_id", "created", "decision", "risk_score", F.size("shadow_matches").cast("bigint").alias("n_shadow"))


@query("decision_set", f"SELECT 'txn_' || id AS payment_id, (CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 15 = 0 THEN 1 ELSE 0 END)::BIGINT AS duplicates, (CASE WHEN id % 15 = 0 THEN 1 ELSE 0 END)::BIGINT AS conflicts FROM ({_P1})")
def _(spark, sf_dir):
    log = logged(spark, sf_dir).withColumn("place", F.lit(0))
    number = F.substring("payment_id", 5, 20).cast("bigint")
    again = log.filter(number % 10 == 0).withColumn("place", F.lit(1)).withColumn("at_ms", F.lit(99).cast("bigint"))
    other = log.filter(number % 15 == 0).withColumn("place", F.lit(2)).withColumn("decision", F.lit("other"))
    return records.decision_set(log.unionByName(again).unionByName(other), ["place"]).select("payment_id", "duplicates", "conflicts")


@query("audit_report", f"SELECT 1::BIGINT AS ruleset_version, count(*) AS records, count(*) FILTER (id % 25 <> 0) AS verified, count(*) FILTER (id % 25 = 0) AS mismatched, 0::BIGINT AS unscored FROM ({_P1})")
def _(spark, sf_dir):
    log = logged(spark, sf_dir)
    changed = F.substring("payment_id", 5, 20).cast("bigint") % 25 == 0
    log = log.withColumn("rule_id", F.when(changed, F.lit("r_other")).otherwise(F.col("rule_id")))
    return audit.audit_report(audit.audit(log, {1: _RULES}, _MODEL, samples.ENCODER, samples.CALIBRATION, "m1"))


def _shadow_sql() -> str:
    rows = [f"SELECT '{r.id}' AS rule_id, count(*)::BIGINT AS evaluated, count(*) FILTER (m_{i}) AS matched, count(*) FILTER (m_{i}) AS predicted, true AS agrees FROM d" for i, r in _RULES.shadows()]
    return f"{_DECIDED} " + " UNION ALL ".join(rows)


@query("shadow_report", _shadow_sql())
def _(spark, sf_dir):
    return audit.shadow_report(logged(spark, sf_dir), _RULES, {r.id: [1] for _, r in _RULES.shadows()})


@query("log_parity", f"SELECT 'only_left' AS what, 0::BIGINT AS n UNION ALL SELECT 'only_right', count(*) FILTER (id % 9 = 0) FROM ({_P1}) UNION ALL SELECT 'both', count(*) FILTER (id % 9 <> 0) FROM ({_P1}) UNION ALL SELECT 'differs:amount', 0 UNION ALL SELECT 'differs:card_txn_count_1h', 0 UNION ALL SELECT 'differs:device_info', 0")
def _(spark, sf_dir):
    table = scored(spark, sf_dir)
    log = records.table_from_log(logged(spark, sf_dir)).filter("id % 9 <> 0")
    return compare.parity(log, table, ["amount", "card_txn_count_1h", "device_info"])


def _signed(secret: bytes, t: Column, payload: Column) -> Column:
    """HMAC-SHA256 of "t.payload" by its definition, apart from the library that verifies it."""
    pad = lambda x: F.lit(bytearray(b ^ x for b in secret.ljust(64, b"\0")))
    inner = F.sha2(F.concat(pad(0x36), F.concat(t, F.lit("."), payload).cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


@query("signatures", f"SELECT id, CASE id % 7 WHEN 0 THEN 'no_matching_signature' WHEN 1 THEN 'malformed_header' WHEN 2 THEN 'malformed_header' WHEN 5 THEN 'timestamp_outside_tolerance' WHEN 6 THEN 'no_matching_signature' END AS signature_error FROM ({_P1})")
def _(spark, sf_dir):
    now = 1_700_000_000
    df = payments(spark, sf_dir).select("id", F.lit(now).alias("now"), F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit("}")).alias("payload"))
    stamp = F.when(F.col("id") % 7 == 5, F.lit(str(now - 301))).otherwise(F.lit(str(now - 300)))
    good, case = _signed(b"secret", stamp, F.col("payload")), F.col("id") % 7
    headers = {1: F.concat(F.lit("v1="), good), 2: F.concat(F.lit("t=1,t=2,v1="), good), 3: F.concat(F.lit("t="), stamp, F.lit(",v1="), good),
               4: F.concat(F.lit("v0=x,v1=00, t="), stamp, F.lit(",v1="), good), 5: F.concat(F.lit("t="), stamp, F.lit(",v1="), good), 6: F.concat(F.lit("t="), stamp, F.lit(",v1="), _signed(b"other", stamp, F.col("payload")))}
    header = F.lit(f"t={now},v1=00")
    for n, h in headers.items():
        header = F.when(case == n, h).otherwise(header)
    return records.verify(df.withColumn("header", header), [b"old", b"secret"]).select("id", "signature_error")


@query("latency_windows", f"""WITH p AS (SELECT (dt // 86400 * 86400)::BIGINT AS start, amount AS v FROM ({_P1})), r AS (SELECT *, row_number() OVER (PARTITION BY start, v IS NULL ORDER BY v) - 1 AS k, count(v) OVER (PARTITION BY start) AS c FROM p), o AS (SELECT start, v, c, CASE WHEN v IS NOT NULL THEN k END AS i FROM r)
SELECT start, count(*) AS n, {oracle.percentile(0.5)} AS p50, {oracle.percentile(0.99)} AS p99, {oracle.percentile(0.999)} AS p999, max(v) AS worst FROM o GROUP BY start""")
def _(spark, sf_dir):
    return compare.latency_windows(payments(spark, sf_dir), "dt", "amount", 86_400)


@query("idempotency_conflicts", f"SELECT card1 AS idempotency_key, count(*) AS requests, count(DISTINCT product_code) AS bodies FROM ({_P1}) GROUP BY 1 HAVING count(DISTINCT product_code) > 1")
def _(spark, sf_dir):
    df = payments(spark, sf_dir).select(F.col("card1").alias("idempotency_key"), F.col("product_code").alias("body"))
    return pipeline.key_conflicts(df)


@query("catalog", f"{_SCORED} " + " UNION ALL ".join(f"SELECT {i} AS place, '{f.name}' AS name, '{f.kind}' AS kind, count({f.name}) AS present FROM t" for i, f in enumerate(FIELDS)))
def _(spark, sf_dir):
    """Every attribute with its kind, and in how many payments it isn't missing."""
    counts = scored(spark, sf_dir).agg(*[F.count(f.name).alias(f.name) for f in FIELDS])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("name"), F.lit(f.kind).alias("kind"), F.col(f.name).alias("present")) for i, f in enumerate(FIELDS)]
    return counts.select(F.inline(F.array(*rows)))


@query("synthetic_payments")
def _(spark, sf_dir):
    """As many made-up payments as there are order lines."""
    return synthetic.generate(spark, max(1, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()))

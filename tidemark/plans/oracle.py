"""DuckDB SQL of what the queries compute, written from the definitions."""

from __future__ import annotations

from tidemark.catalog import DAY, ENTITIES, FEATURES, IDLE_TTL, SHARED, WINDOWS
from tidemark.operators import sketches
from tidemark.operators.ruleset import RuleSet
from tidemark.plans.compiling import sql as rule_sql

_KEYS = {
    "card": ["card1 + 0.0"],
    "uid": ["card1 + 0.0", "billing_region + 0.0", f"floor(dt / {DAY}.0) - d1 + 0.0"],
    "device": ["device_info"],
    "email": ["purchaser_email_domain"],
}
MILLI = "CAST(coalesce(round(amount * 1000), 0) AS BIGINT)"


def velocity(source: str, entities=ENTITIES, buckets: dict[str, int] | None = None, late: bool = False) -> str:
    """WITH clauses that end in f: the payments of `source` with all features.

    late: id says in which order payments arrive, and event_dt when they happened; dt is each key's latest so far.
    """
    parts = [f"p AS ({source})"]
    last = "p"
    for e in entities:
        keys = ", ".join(f"{'CASE WHEN ' + ' AND '.join(f'{x} IS NOT NULL' for x in _KEYS[e]) + ' THEN ' + k + ' END' if len(_KEYS[e]) > 1 else k} AS k{i}" for i, k in enumerate(_KEYS[e]))
        by = ", ".join(f"k{i}" for i in range(len(_KEYS[e])))
        if late:
            keys = keys.replace("floor(dt", "floor(event_dt")
            parts.append(f"{e}k AS (SELECT * EXCLUDE (dt), {MILLI} AS milli, {keys} FROM {last})")
            parts.append(f"{e}0 AS (SELECT *, max(event_dt) OVER (PARTITION BY {by} ORDER BY id ROWS UNBOUNDED PRECEDING) AS dt FROM {e}k)")
        else:
            parts.append(f"{e}0 AS (SELECT *, {MILLI} AS milli, {keys} FROM {last})")
        parts.append(f"{e}1 AS (SELECT *, dt - lag(dt) OVER (PARTITION BY {by} ORDER BY dt, id) AS gap, lag(dt) OVER (PARTITION BY {by}, card1 ORDER BY dt, id) AS ldt, lead(dt) OVER (PARTITION BY {by}, card1 ORDER BY dt, id) AS ndt FROM {e}0)")
        enter = "card1 IS NOT NULL AND (ldt IS NULL OR {} )"
        if buckets is None:
            e_in, e_out, place, length = f"dt - ldt >= {DAY}", f"ndt IS NULL OR ndt - dt >= {DAY}", "dt", DAY
        else:
            b = buckets["24h"]
            place, length = f"CAST(floor(dt / {b}.0) AS BIGINT)", DAY // b + 1
            e_in, e_out = (f"{place} - CAST(floor(ldt / {b}.0) AS BIGINT) >= {length}", f"ndt IS NULL OR CAST(floor(ndt / {b}.0) AS BIGINT) - {place} >= {length}")
        parts.append(f"""{e}2 AS (SELECT *, CASE WHEN gap < {IDLE_TTL} THEN gap END AS g, CASE WHEN {enter.format(e_in)} THEN 1 ELSE 0 END AS enters,
 CASE WHEN card1 IS NOT NULL AND ({e_out}) THEN 1 ELSE 0 END AS leaves FROM {e}1)""")
        cols = [f"count(*) OVER (PARTITION BY {by} ORDER BY dt, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n", f"coalesce(sum(milli) OVER (PARTITION BY {by} ORDER BY dt, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s",
                f"max(CASE WHEN g IS NULL THEN dt END) OVER (PARTITION BY {by} ORDER BY dt, id ROWS UNBOUNDED PRECEDING) AS began"]
        for w, seconds in WINDOWS.items():
            order, back = ("dt", seconds) if buckets is None else (f"CAST(floor(dt / {buckets[w]}.0) AS BIGINT)", seconds // buckets[w] + 1)
            cols += [f"count(*) OVER (PARTITION BY {by} ORDER BY {order} RANGE BETWEEN UNBOUNDED PRECEDING AND {back} PRECEDING) AS n{w}", f"coalesce(sum(milli) OVER (PARTITION BY {by} ORDER BY {order} RANGE BETWEEN UNBOUNDED PRECEDING AND {back} PRECEDING), 0) AS s{w}"]
        if e in SHARED:
            cols += [f"coalesce(sum(enters) OVER (PARTITION BY {by} ORDER BY dt, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dn",
                     f"coalesce(sum(leaves) OVER (PARTITION BY {by} ORDER BY {place} RANGE BETWEEN UNBOUNDED PRECEDING AND {length} PRECEDING), 0) AS dg"]
        parts.append(f"{e}3 AS (SELECT *, {', '.join(cols)} FROM {e}2)")
        has = "k0 IS NOT NULL"
        out = []
        for w in WINDOWS:
            out += [f"CASE WHEN {has} THEN (n - n{w})::DOUBLE END AS {e}_txn_count_{w}", f"CASE WHEN {has} THEN (s - s{w})::DOUBLE / 1000.0::DOUBLE END AS {e}_amount_sum_{w}"]
        mean = "((s - s7d)::DOUBLE / 1000.0::DOUBLE) / nullif((n - n7d)::DOUBLE, 0)"
        out += [f"CASE WHEN {has} THEN {mean} END AS {e}_mean_amount_7d", f"CASE WHEN {has} AND {mean} > 0 THEN amount / ({mean}) END AS {e}_amount_ratio_7d",
                f"CASE WHEN {has} AND g IS NOT NULL THEN (dt - began)::DOUBLE END AS {e}_seconds_since_first", f"CASE WHEN {has} THEN g::DOUBLE END AS {e}_seconds_since_last"]
        if e in SHARED:
            out.append(f"CASE WHEN {has} THEN (dn - dg)::DOUBLE END AS distinct_cards_per_{e}_24h")
        drop = ["milli", *[f"k{i}" for i in range(len(_KEYS[e]))], "gap", "ldt", "ndt", "g", "enters", "leaves", "n", "s", "began", *[f"{x}{w}" for w in WINDOWS for x in "ns"], *(["dn", "dg"] if e in SHARED else [])]
        parts.append(f"{e}4 AS (SELECT * EXCLUDE ({', '.join(drop)}), {', '.join(out)} FROM {e}3)")
        last = f"{e}4"
    parts.append(f"f AS (SELECT * FROM {last})")
    return "WITH " + ",\n".join(parts)


def feature_list(entities=ENTITIES) -> str:
    return ", ".join(c for c in FEATURES if c.split("_")[0] in entities or (c.startswith("distinct") and c.split("_")[3] in entities))


def percentile(q: float, value: str = "v", rank: str = "i", count: str = "c") -> str:
    """An aggregate over values with their ranks from 0 and their count: the percentile at q, between two values lo and hi (1 - f) * lo + f * hi.

    Written out, as engines' own percentiles differ in how they round it.
    """
    place = f"(({count} - 1) * {q!r}::DOUBLE)"
    at = lambda edge: f"max({value}) FILTER ({rank} = {edge}({place}))"
    f = f"max({place} - floor({place}))"
    return f"CASE WHEN {f} = 0 THEN {at('floor')} ELSE (1 - {f}) * {at('floor')} + {f} * {at('ceil')} END"


def scored(source: str, model_sql: str, calibration: str) -> str:
    """velocity's clauses, and t: the feature table with raw_score, probability and risk_score."""
    return velocity(source) + f""",
r AS (SELECT *, {model_sql} AS raw_score FROM (SELECT f.* REPLACE (CASE product_code WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END::DOUBLE AS product_code), product_code AS product FROM f)),
pr AS (SELECT * EXCLUDE (product_code, product), product AS product_code, {calibration} AS probability FROM r),
t AS (SELECT *, is_fraud AS fraud, greatest(least(floor(probability * 100), 99), 0)::DOUBLE AS risk_score FROM pr)"""


def decided(prefix: str, rules: RuleSet) -> str:
    """prefix's clauses, and d: t with m_<i>, rule_index, action and shadow ids."""
    masks = ", ".join(f"coalesce({rule_sql(r.condition, rules.scope)}, false) AS m_{i}" for i, r in enumerate(rules.rules))
    first = " ".join(f"WHEN m_{i} THEN {i}" for i, _ in rules.live())
    action = " ".join(f"WHEN rule_index = {i} THEN '{r.action}'" for i, r in rules.live())
    shadow = ", ".join(f"CASE WHEN m_{i} THEN '{r.id}' END" for i, r in rules.shadows())
    return prefix + f""",
d0 AS (SELECT *, {masks} FROM t),
d1 AS (SELECT *, CASE {first} ELSE -1 END AS rule_index FROM d0),
d AS (SELECT *, CASE {action} ELSE 'allow' END AS action, array_to_string(list_filter([{shadow}], lambda x: x IS NOT NULL), ',') AS shadows FROM d1)"""


def windowed(prefix: str, rules: RuleSet, start: str, end: str, as_of: str, maturity: int, extra: str = "") -> str:
    """prefix's clauses, and w: the period's rows with counted, immature, is_fraud, is_legit and masks."""
    allowed = " OR ".join(f"m_{i}" for i, r in rules.live() if r.action == "allow") or "false"
    young = "false" if maturity < 0 else f"dt >= {as_of} - {maturity}"
    return prefix + f""",
b AS (SELECT min(dt) AS lo, max(dt) + 1 AS hi FROM d),
w AS (SELECT d.* EXCLUDE (is_fraud), {young} AS immature, NOT ({young}) AS counted, NOT ({young}) AND fraud = 1 AS is_fraud, NOT ({young}) AND fraud = 0 AS is_legit,
 {allowed} AS allowed, action = 'block' AS blocked, action = 'review' AS reviewed, {MILLI} AS milli {extra} FROM d, b WHERE dt >= {start} AND dt < {end})"""


def sketched(source: str, entities=ENTITIES) -> str:
    """velocity's clauses, and k: (id, all features) with counts, sums, means, ratios and distinct cards from sketches."""
    number = lambda *x: f"('0x' || substr(md5(concat_ws('|', {', '.join(x)})), 1, 8))::BIGINT"
    thousandths = lambda x: f"CAST(round(({x}) * 1000) AS BIGINT)::VARCHAR"
    parts, joins = [velocity(source, entities)], []
    for e in entities:
        keys = _KEYS[e]
        has = " AND ".join(f"({k}) IS NOT NULL" for k in keys)
        key = "concat_ws('|', " + ", ".join(k if e in SHARED else thousandths(k) for k in keys) + ")"
        parts.append(f"{e}k AS (SELECT id, dt, {MILLI} AS milli, card1, {key} AS key FROM f WHERE {has})")
        parts.append(f"{e}c AS (SELECT id, dt, milli, r, {number(chr(39) + 'c' + chr(39), 'r::VARCHAR', 'key')} % {sketches.WIDTH} AS cell FROM {e}k, range({sketches.ROWS}) t(r))")
        cols = []
        for w, seconds in WINDOWS.items():
            b = f"CAST(floor(dt / {sketches.SKETCH_BUCKETS[w]}.0) AS BIGINT)"
            ring = f"PARTITION BY r, cell ORDER BY {b} RANGE BETWEEN {seconds // sketches.SKETCH_BUCKETS[w]} PRECEDING AND CURRENT ROW"
            rest = f"PARTITION BY r, cell, {b} ORDER BY dt, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
            cols += [f"count(*) OVER ({ring}) - count(*) OVER ({rest}) AS n{w}", f"sum(milli) OVER ({ring}) - sum(milli) OVER ({rest}) AS s{w}"]
        parts.append(f"{e}m AS (SELECT id, " + ", ".join(f"min(n{w})::DOUBLE AS n{w}, min(s{w})::DOUBLE / 1000.0::DOUBLE AS s{w}" for w in WINDOWS) + f" FROM (SELECT id, {', '.join(cols)} FROM {e}c) GROUP BY id)")
        out = [f"n{w} AS {e}_txn_count_{w}, s{w} AS {e}_amount_sum_{w}" for w in WINDOWS]
        mean = "s7d / nullif(n7d, 0)"
        out += [f"{mean} AS {e}_mean_amount_7d", f"CASE WHEN {mean} > 0 THEN amount / ({mean}) END AS {e}_amount_ratio_7d", f"{e}_seconds_since_first", f"{e}_seconds_since_last"]
        more = ""
        if e in SHARED:
            bit = f"CASE WHEN card1 IS NOT NULL THEN {number(chr(39) + 'b' + chr(39), thousandths('card1'))} % {sketches.BITS} END"
            parts.append(f"{e}d AS (SELECT id, dt, r, {number(chr(39) + 'd' + chr(39), 'r::VARCHAR', 'key')} % {sketches.DISTINCT_WIDTH} AS cell, {bit} AS bit, CAST(floor(dt / 3600.0) AS BIGINT) AS h FROM {e}k, range({sketches.DISTINCT_ROWS}) t(r))")
            parts.append(f"{e}x AS (SELECT a.id, a.r, count(DISTINCT b.bit) AS bits FROM {e}d a LEFT JOIN {e}d b ON a.r = b.r AND a.cell = b.cell AND b.h BETWEEN a.h - 24 AND a.h AND (b.dt < a.dt OR b.dt = a.dt AND b.id < a.id) GROUP BY 1, 2)")
            parts.append(f"{e}y AS (SELECT id, round(-{sketches.BITS} * ln(1 - least(min(bits), {sketches.BITS - 1}) / {sketches.BITS}::DOUBLE), 3) + 0.0 AS cards FROM {e}x GROUP BY id)")
            more, out = f" LEFT JOIN {e}y USING (id)", [*out, f"cards AS distinct_cards_per_{e}_24h"]
        parts.append(f"{e}z AS (SELECT f.id, {', '.join(out)} FROM f LEFT JOIN {e}m USING (id){more})")
        joins.append(f"{e}z")
    return ",\n".join(parts) + ",\nk AS (SELECT * FROM " + " JOIN ".join([joins[0], *(f"{j} USING (id)" for j in joins[1:])]) + ")"

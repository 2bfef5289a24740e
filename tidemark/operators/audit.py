"""Decisions made again from their log: audits and reports on shadow rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.model import Calibrator, Model, score
from tidemark.operators.ruleset import RuleSet, decide
from tidemark.plans.compiling import with_conditions
from tidemark.sources.records import catalog_stamp, feature_columns


def audit(log: DataFrame, history: Mapping[int, RuleSet], model: Model | None, encoder: dict | None = None, calibrator: Calibrator | None = None, model_sha256: str = "") -> DataFrame:
    """log's records with mismatches: the names of what differs when each is scored and decided again by its own version.

    A record scored by another model fails the job, as comparing it would say nothing.
    """
    foreign = F.col("scored") & (F.col("model_sha256") != "") & F.lit(model_sha256 != "") & (F.col("model_sha256") != model_sha256)
    stop = F.raise_error(F.concat(F.lit("scored by another model: "), F.col("model_sha256"))).cast("boolean")
    rows = feature_columns(log.withColumn("scored", F.when(foreign, stop).otherwise(F.col("scored"))))
    rows = rows.withColumns({"_risk": F.col("risk_score"), "logged_raw": F.col("raw_score")}).drop("raw_score", "probability", "risk_score")
    if model is not None:
        rows = score(rows, model, encoder or {}, calibrator)
    else:
        rows = rows.withColumns({"raw_score": F.lit(None).cast("double"), "risk_score": F.lit(None).cast("double")})
    rows = rows.withColumn("risk_score", F.when(F.col("scored"), F.col("risk_score")))
    logged = rows.withColumnsRenamed({"decision": "_decision", "rule_id": "_rule_id", "shadow_matches": "_shadow"})
    # every version decides every row in one pass over the log; the row's own version then counts
    said = {"action": F.lit(None).cast("string"), "rule_id": F.lit(None).cast("string"), "shadow_matches": F.lit(None).cast("array<string>")}
    df = logged
    for version, rules in history.items():
        df = decide(df, rules).drop(*[f"m_{i}" for i in range(len(rules.rules))], "rule_index").withColumnsRenamed({c: f"_{c}_{version}" for c in said})
        own = F.col("ruleset_version") == version
        said = {c: F.when(own, F.col(f"_{c}_{version}")).otherwise(x) for c, x in said.items()}
    df = df.withColumns(said)
    known = F.col("action").isNotNull()
    no = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    checks = {
        "catalog": F.col("catalog") != catalog_stamp(),
        "ruleset_version": ~known,
        "raw_score": F.col("scored") & ~F.col("logged_raw").eqNullSafe(F.col("raw_score")),
        "risk_score": F.col("scored") & ~F.col("logged_risk").cast("double").eqNullSafe(F.col("risk_score")),
        "risk_score feature": ~F.col("_risk").eqNullSafe(F.when(F.col("scored"), F.col("logged_risk").cast("double"))),
        "decision": known & ~F.col("_decision").eqNullSafe(F.col("action")),
        "rule_id": known & ~F.col("_rule_id").eqNullSafe(F.col("rule_id")),
        "shadow_matches": known & (no(F.col("_shadow")) != no(F.col("shadow_matches"))),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.select("assessment_id", "payment_id", "ruleset_version", "scored", found.alias("mismatches"))


def audit_report(audited: DataFrame) -> DataFrame:
    """(ruleset_version, records, verified, mismatched, unscored) of an audit."""
    bad = F.size("mismatches") > 0
    return audited.groupBy("ruleset_version").agg(F.count("*").alias("records"), F.count_if(~bad).alias("verified"), F.count_if(bad).alias("mismatched"), F.count_if(~F.col("scored")).alias("unscored"))


def shadow_report(log: DataFrame, rules: RuleSet, live_in: Mapping[str, list[int]]) -> DataFrame:
    """(rule_id, evaluated, matched, predicted, agrees) per shadow rule: what was logged against the rule run over the log.

    live_in: the versions in which each rule was a shadow rule; only their records count.
    """
    aggs, shadows = [], rules.shadows()
    rows = with_conditions(feature_columns(log), {f"_holds_{i}": r.condition for i, r in shadows}, rules.scope)
    for i, r in shadows:
        live = F.col("ruleset_version").isin(*live_in.get(r.id, [])) if live_in.get(r.id) else F.lit(False)
        aggs += [F.count_if(live).alias(f"e{i}"), F.count_if(live & F.array_contains("shadow_matches", r.id)).alias(f"m{i}"), F.count_if(live & F.col(f"_holds_{i}")).alias(f"p{i}")]
    if not shadows:
        return log.sparkSession.createDataFrame([], "rule_id string, evaluated bigint, matched bigint, predicted bigint, agrees boolean")
    each = [F.struct(F.lit(r.id).alias("rule_id"), F.col(f"e{i}").alias("evaluated"), F.col(f"m{i}").alias("matched"), F.col(f"p{i}").alias("predicted"), (F.col(f"m{i}") == F.col(f"p{i}")).alias("agrees")) for i, r in shadows]
    return rows.agg(*aggs).select(F.inline(F.array(*each)))

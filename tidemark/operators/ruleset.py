"""Rule sets over DataFrames: who decides each payment, and what each rule does."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.checking import Scope, load_rules
from tidemark.plans.compiling import with_conditions
from tidemark.plans.language import ACTIONS, Problem, Rule

NO_RULE = -1


@dataclass(frozen=True)
class RuleSet:
    """Rules in source order, with what they can name and the version they carry."""

    rules: tuple[Rule, ...]
    scope: Scope = field(default_factory=Scope)
    version: int = 1
    warnings: tuple[Problem, ...] = ()

    @staticmethod
    def load(text: str, scope: Scope | None = None, version: int = 1) -> RuleSet:
        scope = scope or Scope()
        rules, warnings = load_rules(text, scope)
        return RuleSet(tuple(rules), scope, version, tuple(warnings))

    def live(self) -> list[tuple[int, Rule]]:
        """(index, rule) in the order in which rules decide: allow, block, review."""
        numbered = [(i, r) for i, r in enumerate(self.rules) if not r.shadow]
        return [x for a in ACTIONS for x in numbered if x[1].action == a]

    def shadows(self) -> list[tuple[int, Rule]]:
        return [(i, r) for i, r in enumerate(self.rules) if r.shadow]


def decide(df: DataFrame, rules: RuleSet) -> DataFrame:
    """df with m_<i>, rule_index (NO_RULE if none), action, rule_id and shadow_matches.

    An allow rule that matches wins, then a block, then a review rule, the
    first in source order; a payment without a match is allowed. Shadow rules
    decide nothing.
    """
    df = with_conditions(df, {f"m_{i}": r.condition for i, r in enumerate(rules.rules)}, rules.scope)
    first = F.coalesce(*[F.when(F.col(f"m_{i}"), F.lit(i)) for i, _ in rules.live()], F.lit(NO_RULE))
    df = df.withColumn("rule_index", first)
    # looked up in literals by place, so that code doesn't grow with the rules
    named = lambda values: F.get(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.col("rule_index"))
    action, name = F.coalesce(named([r.action for r in rules.rules]), F.lit("allow")), named([r.id for r in rules.rules])
    seen = [F.when(F.col(f"m_{i}"), F.lit(r.id)) for i, r in rules.shadows()]
    shadow = F.filter(F.array(*seen), lambda x: x.isNotNull()) if seen else F.array().cast("array<string>")
    return df.withColumns({"action": action, "rule_id": name, "shadow_matches": shadow})


def flagged(decided: DataFrame) -> DataFrame:
    """(id, flagged): whether the decision is block or review."""
    return decided.select("id", F.col("action").isin("block", "review").alias("flagged"))


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rule_stats(decided: DataFrame, rules: RuleSet) -> DataFrame:
    """Each rule alone, and what it decides: one row per rule, all from one aggregation.

    decided needs amount and fraud (1 fraud, else not) beside decide's columns.
    """
    fraud = F.col("fraud") == 1
    cents = F.when(fraud, F.coalesce(F.round(F.col("amount") * 1000), F.lit(0.0)).cast("bigint")).otherwise(0)
    aggs = [F.count("*").alias("rows"), F.count_if(fraud).alias("frauds")]
    for i in range(len(rules.rules)):
        m, mine = F.col(f"m_{i}"), F.col("rule_index") == i
        aggs += [
            F.count_if(m).alias(f"a{i}"), F.count_if(m & fraud).alias(f"b{i}"), F.sum(F.when(m, cents).otherwise(0)).alias(f"c{i}"),
            F.count_if(mine).alias(f"d{i}"), F.count_if(mine & fraud).alias(f"e{i}"), F.sum(F.when(mine, cents).otherwise(0)).alias(f"f{i}"),
        ]
    total = decided.agg(*aggs)
    each = [
        F.struct(
            F.lit(i).alias("rule_index"), F.lit(r.id).alias("rule_id"), F.lit(f"shadow {r.action}" if r.shadow else r.action).alias("rule_action"),
            F.col(f"a{i}").alias("matched"), F.col(f"b{i}").alias("fraud"),
            ratio0(F.col(f"b{i}"), F.col(f"a{i}")).alias("precision"), ratio0(F.col(f"b{i}"), F.col("frauds")).alias("fraud_recall"),
            ratio0(F.col(f"a{i}") - F.col(f"b{i}"), F.col("rows") - F.col("frauds")).alias("legit_fpr"),
            F.col(f"d{i}").alias("decided"), F.col(f"e{i}").alias("decided_fraud"),
            (F.coalesce(F.col(f"c{i}"), F.lit(0)) / 1000.0).alias("fraud_dollars"), (F.coalesce(F.col(f"f{i}"), F.lit(0)) / 1000.0).alias("decided_dollars"),
        )
        for i, r in enumerate(rules.rules)
    ]
    return total.select(F.inline(F.array(*each)))


def set_stats(decided: DataFrame) -> DataFrame:
    """The whole set on one row: what it flags, and the shares that are fraud."""
    fraud, hit = F.col("fraud") == 1, F.col("action").isin("block", "review")
    cents = F.coalesce(F.round(F.col("amount") * 1000), F.lit(0.0)).cast("bigint")
    money = lambda cond: F.coalesce(F.sum(F.when(cond, cents)), F.lit(0))
    t = decided.agg(
        F.count("*").alias("rows"), F.count_if(fraud).alias("frauds"), F.count_if(hit).alias("flagged"), F.count_if(hit & fraud).alias("flagged_fraud"),
        F.count_if((F.col("action") == "allow") & (F.col("rule_index") >= 0)).alias("allowed_by_rule"),
        money(fraud).alias("_fm"), money(~fraud).alias("_lm"), money(hit & fraud).alias("_hf"), money(hit & ~fraud).alias("_hl"),
    )
    c = F.col
    return t.select(
        "rows", "frauds", "flagged", "flagged_fraud", "allowed_by_rule",
        ratio0(c("flagged_fraud"), c("flagged")).alias("precision"), ratio0(c("flagged_fraud"), c("frauds")).alias("recall"),
        ratio0(c("flagged") - c("flagged_fraud"), c("rows") - c("frauds")).alias("fpr"),
        ratio0(c("_hf"), c("_fm")).alias("fraud_dollar_recall"), ratio0(c("_hl"), c("_lm")).alias("legit_dollar_share"),
    )

"""What a rule would have done: backtests, sweeps and label delay over decided payments.

Every report is one aggregation over one pass. Money is summed in whole
thousandths, so that no order of summation changes a figure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.words import figure
from tidemark.operators.ruleset import RuleSet, decide
from tidemark.plans.compiling import with_conditions
from tidemark.plans.language import Rule, attributes
from tidemark.shipping import ship

DAY = 86_400
FRAUD, LEGIT, UNKNOWN = 1, 0, -1


@dataclass(frozen=True)
class Options:
    """start, end: the half-open period, 0 for the table's bounds. as_of: today, 0 for end.

    maturity: payments younger than so many seconds are left out; 0 for 60
    days, below 0 for none. use_label_time: labels that came after as_of count
    as not yet seen.
    """

    start: int = 0
    end: int = 0
    as_of: int = 0
    maturity: int = 0
    use_label_time: bool = False

    def resolved(self, df: DataFrame) -> Options:
        start, end = self.start, self.end
        if not start or not end:
            low, high = df.agg(F.min("dt"), F.max("dt")).first()
            start = start or (low if low is not None else 0)
            end = end or (high + 1 if high is not None else start + 1)
        if end <= start:
            raise ValueError(f"the period [{start}, {end}) is empty")
        return Options(start, end, self.as_of or end, self.maturity or 60 * DAY, self.use_label_time)


def thousandths(amount: str = "amount") -> Column:
    return F.coalesce(F.round(F.col(amount) * 1000), F.lit(0.0)).cast("bigint")


def in_time(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.filter((F.col("dt") >= start) & (F.col("dt") < end))


def windowed(df: DataFrame, options: Options) -> DataFrame:
    """The period's rows with counted, immature, is_fraud and is_legit. options must be resolved."""
    young = F.lit(False) if options.maturity < 0 else F.col("dt") >= options.as_of - options.maturity
    late = (F.col("label_time").isNull() | (F.col("label_time") > options.as_of)) if options.use_label_time else F.lit(False)
    fraud = F.col("fraud") == FRAUD
    return in_time(df, options.start, options.end).withColumns({
        "immature": young,
        "counted": ~young,
        "is_fraud": ~young & fraud & ~late,
        "is_legit": ~young & ((F.col("fraud") == LEGIT) | (fraud & late)),
        "_milli": thousandths(),
    })


def decision_masks(rules: RuleSet) -> dict[str, Column]:
    allowed = [F.col(f"m_{i}") for i, r in rules.live() if r.action == "allow"]
    any_ = F.lit(False)
    for m in allowed:
        any_ = any_ | m
    return {"_allowed": any_, "_blocked": F.col("action") == "block", "_reviewed": F.col("action") == "review"}


def changes(action: str) -> Column:
    """Where an enforced rule of this action would change the decision, given that it matches."""
    allowed, blocked, reviewed = F.col("_allowed"), F.col("_blocked"), F.col("_reviewed")
    return {"allow": blocked | reviewed, "block": ~allowed & ~blocked, "review": ~allowed & ~blocked & ~reviewed}[action]


def proposed_on(decided: DataFrame, rules: RuleSet, rule: Rule, options: Options) -> DataFrame:
    """The period's rows with matched and changed for a rule taken as live."""
    df = windowed(decided, options).withColumns(decision_masks(rules))
    df = with_conditions(df, {"_hit": rule.condition}, rules.scope).withColumn("matched", F.col("counted") & F.col("_hit")).drop("_hit")
    return df.withColumn("changed", F.col("matched") & changes(rule.action))


def _groups(action: str) -> dict[str, Column]:
    groups = {"period": F.col("counted"), "immature": F.col("immature"), "matched": F.col("matched"), "changed": F.col("changed")}
    if action == "allow":
        groups |= {"overrides_block": F.col("changed") & F.col("_blocked"), "overrides_review": F.col("changed") & F.col("_reviewed")}
    if action == "block":
        groups["from_review"] = F.col("changed") & F.col("_reviewed")
    return groups


def report(decided: DataFrame, rules: RuleSet, rule: Rule, options: Options) -> DataFrame:
    """(grp, payments, dollars, fraud, fraud_dollars, legit, legit_dollars, unlabeled, unlabeled_dollars,
    precision, fraud_dollar_share, fraud_count_share): one row per group of payments.

    Groups are the period, what is too young, what the rule matches, what it
    would change, and of that what it takes from block or review. Shares are
    of the period's fraud and null where there is none.
    """
    df = proposed_on(decided, rules, rule, options.resolved(decided))
    groups = _groups(rule.action)
    # rows are first counted by their flags, some dozens of combinations, and groups are then sums of those
    flags = {f"_in_{g}": m for g, m in groups.items()} | {"_fraud": F.col("is_fraud"), "_legit": F.col("is_legit")}
    counted = df.select(*[F.coalesce(m, F.lit(False)).alias(n) for n, m in flags.items()], "_milli").groupBy(*flags).agg(F.count("*").alias("_n"), F.sum("_milli").alias("_d"))
    aggs = []
    for g in groups:
        m = F.col(f"_in_{g}")
        for kind, also in (("", F.lit(True)), ("f", F.col("_fraud")), ("l", F.col("_legit"))):
            aggs += [F.coalesce(F.sum(F.when(m & also, F.col(x))), F.lit(0)).alias(f"{g}{x}{kind}") for x in ("_n", "_d")]
    total = counted.agg(*aggs)
    c, share = F.col, lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    rows = [
        F.struct(
            F.lit(g).alias("grp"), c(f"{g}_n").alias("payments"), (c(f"{g}_d") / 1000.0).alias("dollars"),
            c(f"{g}_nf").alias("fraud"), (c(f"{g}_df") / 1000.0).alias("fraud_dollars"), c(f"{g}_nl").alias("legit"), (c(f"{g}_dl") / 1000.0).alias("legit_dollars"),
            (c(f"{g}_n") - c(f"{g}_nf") - c(f"{g}_nl")).alias("unlabeled"),
            ((c(f"{g}_d") - c(f"{g}_df") - c(f"{g}_dl")) / 1000.0).alias("unlabeled_dollars"),
            share(c(f"{g}_nf"), c(f"{g}_nf") + c(f"{g}_nl")).alias("precision"),
            share(c(f"{g}_df"), c("period_df")).alias("fraud_dollar_share"), share(c(f"{g}_nf"), c("period_nf")).alias("fraud_count_share"),
        )
        for g in groups
    ]
    return total.select(F.inline(F.array(*rows)))


def overlaps(decided: DataFrame, rules: RuleSet, rule: Rule, options: Options) -> DataFrame:
    """(rule_index, rule_id, rule_action, both, share, decided_by) for live rules that match what the rule matches, most first."""
    df = proposed_on(decided, rules, rule, options.resolved(decided)).filter("matched")
    live = rules.live()
    if not live:
        return df.sparkSession.createDataFrame([], "rule_index int, rule_id string, rule_action string, both bigint, share double, decided_by bigint")
    aggs = [F.count("*").alias("n")]
    for i, _ in live:
        aggs += [F.count_if(F.col(f"m_{i}")).alias(f"b{i}"), F.count_if(F.col("rule_index") == i).alias(f"d{i}")]
    rows = [
        F.struct(F.lit(i).alias("rule_index"), F.lit(r.id).alias("rule_id"), F.lit(r.action).alias("rule_action"), F.col(f"b{i}").alias("both"),
                 F.try_divide(F.col(f"b{i}").cast("double"), F.col("n").cast("double")).alias("share"), F.col(f"d{i}").alias("decided_by"))
        for i, r in live
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows))).filter("both > 0").orderBy(F.desc("both"), "rule_index")


SAMPLE_FIELDS = ("amount", "product_code", "card_network", "card_type", "purchaser_email_domain", "device_type", "risk_score")


def samples(decided: DataFrame, rules: RuleSet, rule: Rule, options: Options, want: int = 10) -> DataFrame:
    """Up to `want` payments that change (else that match), spread evenly over the period in order of (dt, id).

    Each row's place in that order is counted per day first, so that no task sees all rows.
    """
    df = proposed_on(decided, rules, rule, options.resolved(decided))
    some = df.agg(F.count_if("changed").alias("c"), F.count_if("matched").alias("m")).first()
    pool, n = ("changed", some.c) if some.c else ("matched", some.m)
    k = min(want, n)
    fields = list(dict.fromkeys([*attributes(rule.condition), *SAMPLE_FIELDS]))
    df = df.filter(pool).withColumn("_day", F.floor(F.col("dt") / DAY))
    days = df.groupBy("_day").agg(F.count("*").alias("_n"))
    # one row a day: the running total fits one task
    before = F.coalesce(F.sum("_n").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select("_day", before.alias("_before"))
    placed = df.join(days, "_day").withColumn("_place", F.col("_before") + F.row_number().over(W.partitionBy("_day").orderBy("dt", "id")) - 1)
    chosen = [j * n // k for j in range(k)]
    label = F.when(F.col("is_fraud"), "fraud").when(F.col("is_legit"), "legit").otherwise("unknown")
    after = F.when(F.col("changed"), rule.action).otherwise(F.col("action"))
    hit = placed.filter(F.col("_place").isin(*chosen) if chosen else F.lit(False))
    return hit.select("id", "dt", label.alias("label"), F.col("action").alias("current"), after.alias("proposed"), *[f for f in fields if f in df.columns])


def sweep(decided: DataFrame, rules: RuleSet, options: Options, given_current: bool = False) -> DataFrame:
    """For each threshold 0 to 99 what risk_score >= threshold would match, and its share of all fraud.

    Rows are first counted by whole score, at most 100 groups; the sums from a
    threshold on are then taken over those. given_current leaves out what an
    allow rule protects. Missing and negative scores match no threshold.
    """
    df = windowed(decided, options.resolved(decided)).withColumns(decision_masks(rules)).filter("counted")
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("_milli"))), F.lit(0))
    yes = F.lit(True)
    period = df.agg(F.count_if("is_fraud").alias("_pf"), money(F.col("is_fraud")).alias("_pd"))
    population = df.filter(~F.col("_allowed")) if given_current else df
    bucket = F.least(F.floor("risk_score"), F.lit(99)).cast("int").alias("threshold")
    by = population.filter("risk_score >= 0").groupBy(bucket).agg(
        F.count("*").alias("n"), money(yes).alias("d"), F.count_if("is_fraud").alias("nf"), money(F.col("is_fraud")).alias("df"), F.count_if("is_legit").alias("nl"), money(F.col("is_legit")).alias("dl")
    )
    down = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    all_ = df.sparkSession.range(100).select(F.col("id").cast("int").alias("threshold")).join(F.broadcast(by), "threshold", "left").coalesce(1)
    sums = all_.select("threshold", *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(c) for c in ("n", "d", "nf", "df", "nl", "dl")])
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b.cast("double"))
    return sums.join(F.broadcast(period)).select(
        "threshold", F.col("n").alias("payments"), (F.col("d") / 1000.0).alias("dollars"), F.col("nf").alias("fraud"), (F.col("df") / 1000.0).alias("fraud_dollars"),
        F.col("nl").alias("legit"), (F.col("dl") / 1000.0).alias("legit_dollars"), ratio("nf", F.col("nf") + F.col("nl")).alias("precision"),
        ratio("df", F.col("_pd")).alias("fraud_dollar_recall"), ratio("nf", F.col("_pf")).alias("fraud_count_recall"),
    )


def sweep_totals(decided: DataFrame, rules: RuleSet, options: Options) -> DataFrame:
    """What a sweep leaves out: (protected, protected_dollars, unscored, unscored_dollars)."""
    df = windowed(decided, options.resolved(decided)).withColumns(decision_masks(rules)).filter("counted")
    dollars = lambda c: (F.coalesce(F.sum(F.when(c, F.col("_milli"))), F.lit(0)) / 1000.0)
    protected, unscored = F.col("_allowed"), F.col("risk_score").isNull()
    return df.agg(F.count_if(protected).alias("protected"), dollars(protected).alias("protected_dollars"), F.count_if(unscored).alias("unscored"), dollars(unscored).alias("unscored_dollars"))


# -- label delay ------------------------------------------------------------------


@dataclass(frozen=True)
class Delay:
    """Days from a fraudulent payment to its dispute: lognormal; a draw past max_days never arrives."""

    median_days: float = 30.0
    sigma: float = 0.5
    max_days: float = 120.0
    seed: int = 1

    def arrived_within(self, days: float) -> float:
        if days <= 0:
            return 0.0
        days = min(days, self.max_days) if self.max_days > 0 else days
        z = (math.log(days) - math.log(self.median_days)) / self.sigma
        return 0.5 * math.erfc(-z / math.sqrt(2))

    def days(self, ids: np.ndarray) -> np.ndarray:
        """A draw for each id, from a counter-based generator of (seed, id): splitmix64, then Box and Muller."""
        with np.errstate(over="ignore"):
            x = np.uint64(self.seed) ^ (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            drawn = []
            for _ in range(2):
                x = x + np.uint64(0x9E3779B97F4A7C15)
                z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                drawn.append((z ^ (z >> np.uint64(31))) >> np.uint64(11))
        u1, u2 = (drawn[0].astype(np.float64) + 0.5) / 2.0**53, drawn[1].astype(np.float64) / 2.0**53
        return self.median_days * np.exp(self.sigma * np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2))


def with_simulated_labels(df: DataFrame, delay: Delay = Delay()) -> DataFrame:
    """df with label_time: for fraud dt plus a simulated delay, null where the dispute never arrives or for any other payment."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def days(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in parts:
            yield pd.Series(delay.days(ids.to_numpy()))

    drawn = days(F.col("id"))
    df = df.withColumn("_days", drawn)
    arrives = (F.col("fraud") == FRAUD) & (F.lit(delay.max_days <= 0) | (F.col("_days") <= delay.max_days))
    return df.withColumn("label_time", F.when(arrives, F.col("dt") + F.round(F.col("_days") * DAY).cast("bigint"))).drop("_days")


def label_delay(decided: DataFrame, rules: RuleSet, rule: Rule, as_of: int, window: int, maturity: int) -> DataFrame:
    """The latest window judged by today's labels and by all, and one that ended a maturity earlier likewise.

    (view, start, end_, changed, changed_dollars, caught, caught_dollars, precision, fraud_dollar_share,
    understatement); understatement is 1 - reported / true dollars, on the reported views.
    """
    if window <= 0 or maturity <= 0:
        raise ValueError("window and maturity must be positive")
    df = with_conditions(decided.withColumns(decision_masks(rules)), {"_hit": rule.condition}, rules.scope)
    df = df.withColumn("_hit", F.col("_hit") & changes(rule.action)).withColumn("_milli", thousandths())
    fraud, seen = F.col("fraud") == FRAUD, F.coalesce(F.col("label_time") <= as_of, F.lit(False))
    views = {"naive": (as_of - window, as_of, True), "naive_truth": (as_of - window, as_of, False), "matured": (as_of - maturity - window, as_of - maturity, True), "matured_truth": (as_of - maturity - window, as_of - maturity, False)}
    aggs = []
    for v, (start, end, timed) in views.items():
        inside = (F.col("dt") >= start) & (F.col("dt") < end)
        is_fraud = fraud & seen if timed else fraud
        is_legit = (F.col("fraud") == LEGIT) | (fraud & ~seen) if timed else F.col("fraud") == LEGIT
        hit, money = inside & F.col("_hit"), lambda c: F.coalesce(F.sum(F.when(c, F.col("_milli"))), F.lit(0))
        aggs += [F.count_if(hit).alias(f"{v}_n"), money(hit).alias(f"{v}_d"), F.count_if(hit & is_fraud).alias(f"{v}_c"), money(hit & is_fraud).alias(f"{v}_cd"),
                 F.count_if(hit & is_legit).alias(f"{v}_l"), money(inside & is_fraud).alias(f"{v}_p")]
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    rows = []
    for v, (start, end, _) in views.items():
        under = F.lit(1.0) - ratio(F.col(f"{v}_cd"), F.col(f"{v}_truth_cd")) if not v.endswith("_truth") else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(v).alias("view"), F.lit(start).cast("bigint").alias("start"), F.lit(end).cast("bigint").alias("end_"),
                             F.col(f"{v}_n").alias("changed"), (F.col(f"{v}_d") / 1000.0).alias("changed_dollars"), F.col(f"{v}_c").alias("caught"), (F.col(f"{v}_cd") / 1000.0).alias("caught_dollars"),
                             ratio(F.col(f"{v}_c"), F.col(f"{v}_c") + F.col(f"{v}_l")).alias("precision"), ratio(F.col(f"{v}_cd"), F.col(f"{v}_p")).alias("fraud_dollar_share"), under.alias("understatement")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


# -- words ------------------------------------------------------------------------

#: What is said of a group of payments, and whether beside its share of the period's.
MEASURES = {"payments": False, "dollars": False, "fraud": True, "fraud_dollars": True, "legit": True, "legit_dollars": True, "unlabeled": False}


def facts(rows: list[dict]) -> list[tuple[str, str, float, float | None]]:
    """(group, measure, value, share of the period's value) of a report's rows; without what is zero."""
    period = next((r for r in rows if r["grp"] == "period"), {})
    share = lambda r, m: r[m] / period[m] if MEASURES[m] and period.get(m) and r is not period else None
    return [(r["grp"], m, r[m], share(r, m)) for r in rows for m in MEASURES if r[m]]


def summary(rows: list[dict], rule: Rule, options: Options) -> str:
    """A report as lines: the rule and its days, then a line for each group with what facts() has of it."""
    found = facts(rows)
    lines = [f"{rule.action} over {figure((options.end - options.start) / DAY)} days"]
    if options.use_label_time:
        lines[0] += f", labels known {figure((options.end - options.as_of) / DAY)} days before their end"
    for group in dict.fromkeys(r["grp"] for r in rows):
        said = [f"{m.replace('_', ' ')} {figure(v)}" + ("" if s is None else f" ({figure(100 * s)} %)") for g, m, v, s in found if g == group]
        lines.append(f"{group.replace('_', ' ')}: {', '.join(said) or 'none'}")
    return "\n".join(lines)


class Backtester:
    """A decided table, kept, for proposals one after another."""

    def __init__(self, table: DataFrame, rules: RuleSet):
        self.rules = rules
        self.decided = decide(table, rules).persist()

    def run(self, rule: Rule, options: Options = Options()) -> dict:
        """The report as plain data: groups, overlaps, samples, warnings and a summary."""
        options = options.resolved(self.decided)
        rows = [r.asDict() for r in report(self.decided, self.rules, rule, options).collect()]
        by = {r["grp"]: r for r in rows}
        found = [r.asDict() for r in overlaps(self.decided, self.rules, rule, options).collect()]
        unreachable = by["matched"]["payments"] > 0 and not by["changed"]["payments"]
        covered = sorted((o for o in found if o["decided_by"]), key=lambda o: (-o["decided_by"], o["rule_index"])) if unreachable else []
        warnings = []
        if not by["matched"]["payments"]:
            warnings.append("The rule matches no payment of this period.")
        if unreachable:
            warnings.append("Rules in force decide all that the rule matches.")
        if rule.shadow:
            warnings.append("A shadow rule; this is what it would do if it were enforced.")
        return {
            "rule": rule.text, "rule_id": rule.id, "groups": by, "overlaps": found, "unreachable": unreachable, "covered_by": covered, "warnings": warnings,
            "samples": [r.asDict() for r in samples(self.decided, self.rules, rule, options).collect()], "summary": summary(rows, rule, options),
        }

    def close(self) -> None:
        self.decided.unpersist()

"""Risk scores, labels, agreement and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.operators import policy as P


def contributions(signals: DataFrame, policy: P.Policy) -> DataFrame:
    """Adds contribution: the larger of the label's and the signal's weight, times the source's weight, the
    confidence and the severity's multiplier."""
    weight = F.greatest(P.lookup(policy.label_weights, F.col("label"), 10.0).cast("double"), F.col("risk_weight").cast("double"))
    source = P.lookup(policy.source_weights, F.col("source"), 1.0)
    severity = P.lookup(policy.severity_multipliers, F.col("severity").cast("int"), 1.0)
    return signals.withColumn("contribution", weight * source * F.col("confidence") * severity)


def _rank(policy: P.Policy, label: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, policy.priority)), label), F.lit(0)) - 1, F.lit(999))


def evaluate(messages: DataFrame, key: str, signals: DataFrame, policy: P.Policy, context: DataFrame | None = None) -> DataFrame:
    """One row a message: risk_score, primary_label, labels, confidence, severity, agreement, disagreement,
    multiplier, conflicts and rule_ids. Messages without signals are SAFE with risk 0. Two aggregations
    on one shuffle of the signals: by message and label, then by message, both partial first."""
    s = contributions(signals, policy)
    n = len(policy.priority)
    bonus = F.greatest(F.lit(n) - _rank(policy, F.col("label")), F.lit(0))
    model = F.when((F.col("confidence") >= policy.high_confidence) & (F.col("label") != "SAFE"),
                   F.when(F.col("source") == "RUBERT", 6).when(F.col("source") == "QWEN", 8).otherwise(0)).otherwise(0)
    best = F.struct((F.col("contribution") + 0.5 * bonus + model).alias("score"), F.col("severity"), bonus.alias("bonus"), F.col("confidence"), (-F.col("pos")).alias("before"), F.col("label"))
    sure = F.col("source").isin("RUBERT", "QWEN") & (F.col("confidence") >= policy.high_confidence)
    last = lambda source: F.max(F.when(sure & (F.col("source") == source), F.struct("pos", "label")))
    by_label = s.groupBy(key, "label").agg(
        F.max("contribution").alias("most"), F.max(best).alias("best"), F.max("confidence").alias("confidence"), F.max("severity").alias("severity"),
        last("RUBERT").alias("rubert"), last("QWEN").alias("qwen"),
        F.collect_list(F.when(F.col("rule_id").isNotNull(), F.struct("pos", "rule_id"))).alias("ids"),
    )
    agg = by_label.groupBy(key).agg(
        F.sum("most").alias("total"), F.max("best").alias("best"), F.max("confidence").alias("confidence"), F.max("severity").alias("severity"),
        F.max("rubert").alias("rubert"), F.max("qwen").alias("qwen"), F.collect_set("label").alias("set"),
        F.transform(F.array_sort(F.flatten(F.collect_list("ids"))), lambda x: x["rule_id"]).alias("rule_ids"),
    )
    x = messages.select(key).join(agg, key, "left")
    if context is not None:
        x = x.join(context, key, "left")
    harmful = F.array_except("set", F.array(F.lit("SAFE")))
    ordered = F.array(*map(F.lit, policy.priority))
    in_order = lambda a: F.filter(ordered, lambda p: F.array_contains(a, p))
    first = F.coalesce(F.col("best.label"), F.lit("SAFE"))
    safe_clash = F.array_contains("set", "SAFE") & (F.size("set") > 1)
    resolved = F.when(safe_clash & (first == "SAFE"), F.coalesce(F.get(in_order(harmful), F.lit(0)), F.lit("SAFE"))).otherwise(first)
    url_scam = F.array_contains("set", "URL") & F.array_contains("set", "SCAM") & (resolved == "URL")
    both = F.col("rubert").isNotNull() & F.col("qwen").isNotNull()
    agree = F.col("rubert.label") == F.col("qwen.label")
    agreement = F.when(~both, 1.0).when(agree, 1 + policy.agreement_bonus).otherwise(1 - policy.disagreement_penalty)
    risk = F.greatest(F.least(F.coalesce("total", F.lit(0.0)), F.lit(float(policy.risk_max))), F.lit(float(policy.risk_min)))
    x = x.withColumns({"_safe": F.coalesce(safe_clash, F.lit(False)), "_first": first, "_resolved": resolved, "_scam": F.coalesce(url_scam, F.lit(False)),
                       "agreement": agreement, "disagreement": F.coalesce(both & ~agree, F.lit(False)), "_risk": risk})
    times = user_multiplier(x, policy) if context is not None else F.lit(1.0)
    x = x.withColumn("multiplier", times)
    final = F.greatest(F.least(F.col("_risk") * F.col("agreement") * F.col("multiplier"), F.lit(float(policy.risk_max))), F.lit(float(policy.risk_min)))
    notes = F.array_compact(F.array(
        F.when(F.col("_safe"), F.lit("safe_with_harmful")),
        F.when(F.col("_safe") & (F.col("_first") == "SAFE"), F.lit("primary_was_safe")),
        F.when(F.col("_scam"), F.lit("url_with_scam")),
    ))
    labels = F.when(F.size(harmful) > 0, in_order(harmful)).otherwise(F.array(F.lit("SAFE")))
    return x.select(
        key,
        F.round(final, 4).alias("risk_score"),
        F.when(F.col("_scam"), "SCAM").otherwise(F.col("_resolved")).alias("primary_label"),
        F.coalesce(labels, F.array(F.lit("SAFE"))).alias("labels"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("severity", F.lit(0)).alias("severity"),
        "agreement", "disagreement", "multiplier",
        notes.alias("conflicts"),
        F.coalesce("rule_ids", F.array().cast("array<string>")).alias("rule_ids"),
    )


def user_multiplier(df: DataFrame, policy: P.Policy) -> Column:
    """The product of what the user's account_age_days, member_age_days, violations and escalation add, up to
    the greatest; unknown values add nothing. Counts may be strings."""
    number = lambda c, kind: F.coalesce(F.col(c).cast("string").try_cast(kind), F.lit(0)) if c in df.columns else F.lit(0)
    young = lambda c, days: F.coalesce(F.col(c) < days, F.lit(False)) if c in df.columns else F.lit(False)
    out = (
        F.when(young("account_age_days", policy.new_account_days), policy.new_account_multiplier).otherwise(1.0)
        * F.when(young("member_age_days", policy.new_member_days), policy.new_member_multiplier).otherwise(1.0)
        * F.when(number("violations", "int") >= policy.violation_threshold, policy.repeat_multiplier).otherwise(1.0)
        * F.when(number("escalation", "double") >= policy.escalation_threshold, policy.repeat_multiplier).otherwise(1.0)
    )
    return F.least(out, F.lit(policy.max_multiplier))


def decide(evaluated: DataFrame, policy: P.Policy) -> DataFrame:
    """Adds action, reason, plan, required_actions and action_required. Disagreement asks for review before
    all else; then a label's override, or the ladder; then low confidence and the mode soften it."""
    risk = F.col("risk_score")
    if policy.mode == "STRICT":
        risk = F.least(risk * policy.strict_multiplier, F.lit(100.0))
    ladder = F.lit("IGNORE")
    for action, least in sorted(policy.ladder, key=lambda x: x[1]):
        ladder = F.when(risk >= least, action).otherwise(ladder)
    override = P.lookup(policy.overrides, F.col("primary_label"))
    chosen = F.coalesce(override, ladder)
    floor = policy.min_action_confidence - (policy.strict_confidence_reduction if policy.mode == "STRICT" else 0)
    soft = F.when(chosen.isin("DELETE", "DELETE_WARN", "BAN", "TIMEOUT") & (F.col("confidence") < floor), "REVIEW").otherwise(chosen)
    if policy.mode == "PASSIVE":
        order = F.array(*map(F.lit, policy.action_priority))
        rank = lambda a: F.coalesce(F.nullif(F.array_position(order, a), F.lit(0)), F.lit(999))
        most = F.lit(policy.passive_max_action)
        soft = F.when(rank(soft) < rank(most), most).otherwise(soft)
    x = evaluated.withColumn("action", F.when(F.col("disagreement"), "REVIEW").otherwise(soft))
    reason = F.when(F.col("disagreement"), "disagreement").when(override.isNotNull(), "override").otherwise("threshold")
    plan = F.array_distinct(F.coalesce(P.lookup(policy.bundles, F.col("action")), F.array("action")))
    return x.withColumn("reason", reason).withColumn("plan", plan).withColumns({
        "required_actions": F.array_remove("plan", F.col("action")),
        "action_required": F.exists("plan", lambda a: a != "IGNORE"),
    })


def steps(decisions: DataFrame, key: str, policy: P.Policy, status: dict | None = None) -> DataFrame:
    """(key, pos, action, status): what simulating each planned action gives. status: of each action on the
    platform, where the policy isn't a dry run."""
    p = decisions.select(key, F.posexplode("plan").alias("at", "planned"))
    done = F.lit("DRY_RUN") if policy.dry_run else P.lookup(status or {"": ""}, F.col("planned"), "SUCCESS")
    one = lambda a, s: F.struct(a.alias("action"), (F.lit(s) if isinstance(s, str) else s).alias("status"))
    if not policy.actions_enabled:
        todo = F.array(one(F.col("planned"), "SKIPPED"))
    else:
        skip = F.array(one(F.col("planned"), "SKIPPED"))
        review = F.lit("REVIEW")
        if "REVIEW" in policy.allowed_actions:
            reviewed = F.array(one(review, "DRY_RUN" if policy.dry_run else P.lookup(status or {"": ""}, review, "SUCCESS")), one(F.col("planned"), "SKIPPED"))
        else:
            reviewed = skip
        todo = (
            F.when(F.col("planned") == "IGNORE", skip)
            .when(~F.col("planned").isin(*policy.allowed_actions), skip)
            .when(F.col("planned").isin(*policy.reviewed_actions), reviewed)
            .otherwise(F.array(one(F.col("planned"), done)))
        )
    out = p.select(key, "at", F.posexplode(todo).alias("sub", "s"))
    return out.select(key, (F.col("at") * 2 + F.col("sub")).alias("pos"), "s.action", "s.status")


def plan_status(step_rows: DataFrame, key: str) -> DataFrame:
    """(key, status, executed): the steps' joint status, and the actions that were or would be carried out."""
    s = F.col("status")
    agg = step_rows.groupBy(key).agg(
        F.bool_and(s == "DRY_RUN").alias("dry"), F.bool_or(s == "FAILED").alias("failed"), F.bool_or(s.isin("SUCCESS", "DRY_RUN")).alias("some"),
        F.bool_and(s == "SUCCESS").alias("all_done"), F.bool_and(s == "SKIPPED").alias("skipped"),
        F.array_sort(F.collect_list(F.when(s.isin("SUCCESS", "DRY_RUN"), F.struct("pos", "action")))).alias("done"),
    )
    status = (
        F.when(F.col("dry"), "DRY_RUN").when(F.col("failed") & F.col("some"), "PARTIAL_SUCCESS").when(F.col("failed"), "FAILED")
        .when(F.col("all_done"), "SUCCESS").when(F.col("skipped"), "SKIPPED").otherwise("PARTIAL_SUCCESS")
    )
    return agg.select(key, status.alias("status"), F.transform("done", lambda d: d["action"]).alias("executed"))

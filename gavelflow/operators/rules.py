"""Rules to matches, matches to signals, and the filters and joins on signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.functions import text as T
from gavelflow.operators import policy as P

SIGNAL = "pos int, source string, label string, confidence double, severity int, risk_weight double, rule_id string"


def _column(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def conditions(df: DataFrame, policy: P.Policy, words: dict | None = None) -> dict[str, Column]:
    """When each rule fires, over feature columns; columns that df lacks count as none. words: lists for
    the keyword rules (blacklist, hate, nsfw, politics). Disabled rules have no condition, so that they
    aren't in the plan at all."""
    words = words or {}
    r = {k.removeprefix("preprocessing."): v for k, v in policy.rules.items() if v.enabled}
    normal = F.lower(F.coalesce(F.col("text"), F.lit(""))) if "text" in df.columns else F.lit("")
    long = _column(df, "text_length", 0)
    out: dict[str, Column] = {}

    def at_least(name: str, column: str) -> None:
        if name in r:
            out[name] = (_column(df, column, 0) >= r[name].threshold) & (long >= r[name].minimum_length)

    for name, key in (("blacklist_words.detected", "blacklist"), ("semantic.hate", "hate"), ("semantic.nsfw", "nsfw"), ("semantic.politics", "politics")):
        if name in r and words.get(key):
            out[name] = T.any_keyword(normal, words[key])
    for kind in ("obscene", "literary"):
        if f"russian_profanity.{kind}" in r and f"profanity_{kind}" in df.columns:
            out[f"russian_profanity.{kind}"] = F.col(f"profanity_{kind}")
    at_least("flood.messages_10s", "messages_10s")
    at_least("flood.messages_60s", "messages_60s")
    at_least("flood.repeated_messages_10m", "repeated_10m")
    at_least("spam.mass_mentions", "mention_count")
    if "targeted.mass_mentions" in r:
        harmful = [c for k, c in out.items() if k.startswith(("semantic.hate", "russian_profanity"))]
        any_harm = F.lit(False)
        for c in harmful:
            any_harm = any_harm | c
        if harmful:
            out["targeted.mass_mentions"] = (_column(df, "mention_count", 0) >= r["targeted.mass_mentions"].threshold) & any_harm
    at_least("spam.caps", "uppercase_ratio")
    at_least("spam.emoji", "emoji_ratio")
    at_least("spam.repeated_chars", "repeated_char_score")
    if "spam.repeated_words" in r:
        rule = r["spam.repeated_words"]
        out["spam.repeated_words"] = (
            (_column(df, "max_word_repetition_count", 0) >= rule.threshold)
            & (_column(df, "word_count", 0) >= rule.minimum_length)
            & (_column(df, "max_word_repetition_ratio", 0.0) >= rule.minimum_ratio)
        )
    if "invites" in df.columns and "invite.detected" in r:
        out["invite.detected"] = F.size(F.array_except("invites", F.lit(words.get("allowed_invites", [])).cast("array<string>") if words.get("allowed_invites") else F.array().cast("array<string>"))) > 0
    if "domains" in df.columns:
        allowed = words.get("allowed_domains", P.ALLOWED_DOMAINS)
        if "url.detected" in r:
            out["url.detected"] = F.exists("domains", lambda d: ~T.matches_suffix(d, allowed))
        if "url.shortener" in r:
            out["url.shortener"] = F.exists("domains", lambda d: T.matches_suffix(d, P.SHORTENERS) & ~T.matches_suffix(d, allowed))
    if "evasion.unicode" in r and "has_mixed_scripts" in df.columns:
        out["evasion.unicode"] = F.col("has_mixed_scripts") | F.col("has_suspicious_unicode") | _column(df, "separator_obfuscation", False)
    return out


def _rule_id(df: DataFrame, rule_id: str) -> Column:
    """The rule's id; evasion by spelling out a listed word has one of its own."""
    if rule_id.endswith("evasion.unicode") and "separator_obfuscation" in df.columns:
        return F.when(F.col("separator_obfuscation"), "preprocessing.evasion.separator_obfuscation").otherwise(rule_id)
    return F.lit(rule_id)


def emit(df: DataFrame, policy: P.Policy, words: dict | None = None) -> DataFrame:
    """Adds matches: array<struct<rule_id, labels, severity, confidence, risk_weight>>, in rule order."""
    each = []
    for name, when in conditions(df, policy, words).items():
        rule = policy.rules["preprocessing." + name]
        each.append(
            F.when(
                when,
                F.struct(
                    _rule_id(df, rule.rule_id).alias("rule_id"),
                    F.array(*map(F.lit, rule.labels)).alias("labels"),
                    F.lit(rule.severity).alias("severity"),
                    F.lit(float(rule.confidence)).alias("confidence"),
                    F.lit(float(rule.risk_weight)).alias("risk_weight"),
                ),
            )
        )
    return df.withColumn("matches", F.array_compact(F.array(*each)))


def to_signals(df: DataFrame, key: str, policy: P.Policy) -> DataFrame:
    """(key, pos, source, label, confidence, severity, risk_weight, rule_id): a row for each label of each
    match, in order. Labels without a priority are left out."""
    flat = F.flatten(F.transform("matches", lambda m: F.transform(m["labels"], lambda x: F.struct(
        x.alias("label"), m["confidence"].alias("confidence"), m["severity"].alias("severity"), m["risk_weight"].alias("risk_weight"), m["rule_id"].alias("rule_id")
    ))))
    known = F.filter(flat, lambda s: s["label"].isin(*policy.priority))
    return df.select(key, F.posexplode(known).alias("pos", "s")).select(key, "pos", F.lit("PREPROCESSING").alias("source"), "s.label", "s.confidence", "s.severity", "s.risk_weight", "s.rule_id")


def confident(signals: DataFrame, policy: P.Policy) -> DataFrame:
    """Signals that reach the threshold of their label, else of their source, else the general one."""
    least = F.coalesce(P.lookup(policy.label_confidence, F.col("label")), P.lookup(policy.source_confidence, F.col("source")), F.lit(policy.min_confidence))
    return signals.where(F.col("confidence") >= least)


def score_signals(scores: DataFrame, key: str, policy: P.Policy, source: str = "RUBERT", threshold: float = 0.5) -> DataFrame:
    """Signals from a table (key, label, score) of a classifier: labels at or over the threshold, SAFE only
    alone."""
    picked = scores.where(F.col("score") >= threshold)
    other = picked.where("label <> 'SAFE'").select(key).distinct().withColumn("_harm", F.lit(True))
    picked = picked.join(other, key, "left").where("label <> 'SAFE' or _harm is null").drop("_harm")
    return picked.select(
        key,
        F.lit(1000).alias("pos"),
        F.lit(source).alias("source"),
        "label",
        F.col("score").alias("confidence"),
        P.lookup(P.CLASSIFIER_SEVERITY, F.col("label"), 0).alias("severity"),
        F.floor(P.lookup(policy.label_weights, F.col("label"), 0)).cast("double").alias("risk_weight"),
        F.concat(F.lit(source.lower() + "."), F.lower("label")).alias("rule_id"),
    )

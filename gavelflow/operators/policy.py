"""Policies: their values, validation, loading, scopes and resolution."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelflow.functions.text import SHORTENERS  # noqa: F401

# The labels, in the order that makes a label's bit in a mask.
LABELS = ("SAFE", "SPAM", "ADVERTISEMENT", "INVITE", "SCAM", "TOXIC", "PROFANITY", "POLITICS_IRL", "HATE", "THREAT", "NSFW", "EVASION", "URL")
# Which label of several is primary; the first wins.
PRIORITY = ("THREAT", "HATE", "SCAM", "NSFW", "TOXIC", "POLITICS_IRL", "PROFANITY", "INVITE", "FLOOD", "SPAM", "ADVERTISEMENT", "URL", "EVASION", "SAFE")
# Risk by label, source and severity.
LABEL_WEIGHTS = {"SAFE": 0, "SPAM": 20, "ADVERTISEMENT": 15, "INVITE": 10, "SCAM": 50, "TOXIC": 30, "PROFANITY": 8, "POLITICS_IRL": 18, "HATE": 60, "THREAT": 80, "NSFW": 70, "EVASION": 30, "FLOOD": 10, "URL": 5}
SOURCE_WEIGHTS = {"PREPROCESSING": 1.0, "RUBERT": 1.2, "QWEN": 1.5, "OCR": 1.0, "IMAGE": 1.0, "HISTORY": 0.8, "MANUAL": 2.0, "PHISHING": 1.4}
SEVERITY_MULTIPLIERS = {0: 0.0, 1: 0.5, 2: 0.8, 3: 1.0, 4: 1.2, 5: 1.5}
MIN_CONFIDENCE = 0.4
SOURCE_CONFIDENCE = {"PREPROCESSING": 0.3, "RUBERT": 0.5, "QWEN": 0.6, "OCR": 0.6, "IMAGE": 0.7, "PHISHING": 0.5}
LABEL_CONFIDENCE = {"THREAT": 0.3, "HATE": 0.3, "SCAM": 0.6, "NSFW": 0.6, "SAFE": 0.1}
# A classifier's severity by label.
CLASSIFIER_SEVERITY = {"SAFE": 0, "URL": 1, "SPAM": 2, "ADVERTISEMENT": 2, "EVASION": 2, "PROFANITY": 1, "POLITICS_IRL": 2, "INVITE": 3, "TOXIC": 3, "SCAM": 4, "NSFW": 4, "HATE": 5, "THREAT": 5, "FLOOD": 2}
# Decisions.
LADDER = (("BAN", 95), ("TIMEOUT", 90), ("DELETE_WARN", 80), ("DELETE", 70), ("WARN", 50), ("REVIEW", 40), ("LOG", 10), ("IGNORE", 0))
OVERRIDES = {"THREAT": "DELETE", "HATE": "DELETE", "SCAM": "DELETE", "NSFW": "REVIEW", "POLITICS_IRL": "REVIEW"}
BUNDLES = {"DELETE_WARN": ["WARN"], "TIMEOUT": ["DELETE", "TIMEOUT"], "BAN": ["DELETE", "BAN"]}
ACTION_PRIORITY = ("BAN", "TIMEOUT", "DELETE_WARN", "DELETE", "WARN", "REVIEW", "LOG", "IGNORE")
ALLOWED_ACTIONS = ("LOG", "REVIEW", "WARN", "DELETE", "TIMEOUT", "BAN")
REVIEWED_ACTIONS = ("BAN",)
# Hosts.
ALLOWED_DOMAINS = ("youtube.com", "youtu.be", "tiktok.com", "vm.tiktok.com")
SUSPICIOUS_WORDS = ("airdrop", "bonus", "claim", "crypto", "gift", "login", "promo", "verify", "wallet")
# Scopes, the most specific first.
SCOPES = ("USER", "ROLE", "CHANNEL", "GUILD", "CHAT", "PLATFORM", "GLOBAL")


@dataclass(frozen=True)
class Rule:
    """What a rule emits, and when."""

    rule_id: str
    labels: tuple[str, ...]
    severity: int
    confidence: float
    risk_weight: int
    threshold: float = 1
    minimum_length: int = 0
    minimum_ratio: float = 0.0
    enabled: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.severity <= 5:
            raise ValueError(f"{self.rule_id}: severity {self.severity}")
        if not 0 <= self.confidence <= 1:
            raise ValueError(f"{self.rule_id}: confidence {self.confidence}")
        if self.risk_weight < 0 or not self.labels:
            raise ValueError(f"{self.rule_id}: needs labels and a weight of 0 or more")


_P = "preprocessing."
# The rules' default parameters, in the order of evaluation.
RULES = {r.rule_id: r for r in (
    Rule(_P + "blacklist_words.detected", ("SPAM",), 2, 0.75, 25),
    Rule(_P + "semantic.hate", ("HATE",), 5, 0.82, 60, enabled=False),
    Rule(_P + "semantic.nsfw", ("NSFW",), 4, 0.82, 70, enabled=False),
    Rule(_P + "semantic.politics", ("POLITICS_IRL",), 2, 0.90, 18, enabled=False),
    Rule(_P + "russian_profanity.obscene", ("PROFANITY",), 1, 0.94, 8, enabled=False),
    Rule(_P + "russian_profanity.literary", ("PROFANITY",), 1, 0.82, 5, enabled=False),
    Rule(_P + "flood.messages_10s", ("FLOOD",), 3, 0.82, 18, 4),
    Rule(_P + "flood.messages_60s", ("FLOOD",), 3, 0.86, 24, 8),
    Rule(_P + "flood.repeated_messages_10m", ("FLOOD",), 3, 0.78, 22, 4),
    Rule(_P + "spam.mass_mentions", ("SPAM",), 2, 0.74, 25, 5),
    Rule(_P + "targeted.mass_mentions", ("TOXIC",), 3, 0.82, 32, 3),
    Rule(_P + "spam.caps", ("SPAM",), 1, 0.58, 10, 0.65, 8),
    Rule(_P + "spam.emoji", ("SPAM",), 1, 0.52, 8, 0.35, 4),
    Rule(_P + "spam.repeated_chars", ("SPAM",), 1, 0.56, 10, 0.4, 6),
    Rule(_P + "spam.repeated_words", ("SPAM",), 2, 0.72, 20, 5, 5, 0.5),
    Rule(_P + "invite.detected", ("INVITE",), 3, 0.90, 45),
    Rule(_P + "url.detected", ("URL",), 1, 0.55, 10),
    Rule(_P + "url.shortener", ("URL", "SPAM"), 2, 0.68, 20),
    Rule(_P + "evasion.unicode", ("EVASION",), 2, 0.64, 20),
)}


@dataclass(frozen=True)
class Policy:
    """All that scoring and decisions depend on; every value can be replaced."""

    rules: dict[str, Rule] = field(default_factory=lambda: dict(RULES))
    label_weights: dict[str, float] = field(default_factory=lambda: dict(LABEL_WEIGHTS))
    source_weights: dict[str, float] = field(default_factory=lambda: dict(SOURCE_WEIGHTS))
    severity_multipliers: dict[int, float] = field(default_factory=lambda: dict(SEVERITY_MULTIPLIERS))
    min_confidence: float = MIN_CONFIDENCE
    source_confidence: dict[str, float] = field(default_factory=lambda: dict(SOURCE_CONFIDENCE))
    label_confidence: dict[str, float] = field(default_factory=lambda: dict(LABEL_CONFIDENCE))
    priority: tuple[str, ...] = PRIORITY
    risk_min: float = 0.0
    risk_max: float = 100.0
    agreement_bonus: float = 0.2
    disagreement_penalty: float = 0.3
    high_confidence: float = 0.8
    new_account_days: int = 7
    new_member_days: int = 7
    violation_threshold: int = 3
    escalation_threshold: float = 3.0
    new_account_multiplier: float = 1.15
    new_member_multiplier: float = 1.1
    repeat_multiplier: float = 1.35
    max_multiplier: float = 1.75
    mode: str = "ACTIVE"
    ladder: tuple[tuple[str, float], ...] = LADDER
    overrides: dict[str, str] = field(default_factory=lambda: dict(OVERRIDES))
    bundles: dict[str, list[str]] = field(default_factory=lambda: dict(BUNDLES))
    action_priority: tuple[str, ...] = ACTION_PRIORITY
    min_action_confidence: float = 0.6
    strict_multiplier: float = 1.2
    strict_confidence_reduction: float = 0.1
    passive_max_action: str = "REVIEW"
    allowed_actions: tuple[str, ...] = ALLOWED_ACTIONS
    reviewed_actions: tuple[str, ...] = REVIEWED_ACTIONS
    actions_enabled: bool = True
    dry_run: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.risk_min <= self.risk_max <= 100:
            raise ValueError("risk range")
        if self.mode not in ("ACTIVE", "PASSIVE", "STRICT"):
            raise ValueError(f"mode {self.mode}")
        for name in ("label_confidence", "source_confidence"):
            if not all(math.isfinite(v) and 0 <= v <= 1 for v in getattr(self, name).values()):
                raise ValueError(name)
        if any(v < 0 for v in (*self.label_weights.values(), *self.source_weights.values())):
            raise ValueError("weights are 0 or more")
        if any(not 0 <= v <= 100 for _, v in self.ladder):
            raise ValueError("ladder")

    def with_rules(self, **changes: dict[str, Any]) -> Policy:
        """Rules with some fields replaced; keys are rule ids after 'preprocessing.', dots as two underscores."""
        rules = dict(self.rules)
        for key, part in changes.items():
            name = _P + key.replace("__", ".")
            rules[name] = dataclasses.replace(rules[name], **part)
        return dataclasses.replace(self, rules=rules)


def parse(document: dict[str, Any], base: Policy | None = None) -> Policy:
    """A policy from a parsed document: known keys replace the base's, rules field by field. Unknown keys are
    an error, as is a value of another type."""
    base = base or Policy()
    known = {f.name for f in dataclasses.fields(Policy)}
    document = document.get("policy", document)
    if extra := set(document) - known:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    values = {k: v for k, v in document.items() if k != "rules"}
    for k, v in values.items():
        old = getattr(base, k)
        if isinstance(old, dict):
            values[k] = {**old, **v}
        elif isinstance(old, tuple):
            values[k] = tuple(tuple(x) if isinstance(x, list) else x for x in v)
        elif isinstance(old, bool) != isinstance(v, bool) or isinstance(old, str) != isinstance(v, str):
            raise ValueError(f"{k}: {v!r}")
    rules = dict(base.rules)
    for name, part in (document.get("rules") or {}).items():
        if name not in rules:
            raise ValueError(f"unknown rule {name}")
        rules[name] = dataclasses.replace(rules[name], **{k: tuple(v) if k == "labels" else v for k, v in part.items()})
    return dataclasses.replace(base, rules=rules, **values)


def violations(policy: Policy) -> list[str]:
    """What rules ask for that the scoring side doesn't know or would drop."""
    out = []
    for r in policy.rules.values():
        if r.severity not in policy.severity_multipliers:
            out.append(f"{r.rule_id}: severity {r.severity} has no multiplier")
        if r.risk_weight > policy.risk_max:
            out.append(f"{r.rule_id}: weight above the greatest risk")
        for label in r.labels:
            floor = policy.label_confidence.get(label, policy.source_confidence.get("PREPROCESSING", policy.min_confidence))
            if label not in policy.priority:
                out.append(f"{r.rule_id}: {label} has no priority")
            if r.confidence < floor:
                out.append(f"{r.rule_id}: confidence below the threshold of {label}")
            if policy.label_weights.get(label, 10) <= 0 and r.risk_weight <= 0:
                out.append(f"{r.rule_id}: {label} has no weight")
    return out


def coerced(values: str | list | None, domains: bool = False) -> list[str]:
    """A list from a list or a comma-separated string: trimmed, lower case, without www. for domains, each
    once, in the order of first occurrence."""
    items = values.split(",") if isinstance(values, str) else list(values or [])
    out = [str(x).strip().lower() for x in items]
    if domains:
        out = [x.removeprefix("www.") for x in out]
    return [x for x in dict.fromkeys(out) if x]


def scope_chain(user: Column, roles: Column, channel: Column, guild: Column, chat: Column, platform: Column) -> Column:
    """array<struct<scope_type, scope_id>>, the most specific first; missing ids are left out."""
    one = lambda kind, c: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("scope_type"), c.cast("string").alias("scope_id")))
    role = F.transform(F.coalesce(roles, F.array().cast("array<string>")), lambda r: F.struct(F.lit("ROLE").alias("scope_type"), r.alias("scope_id")))
    everywhere = F.struct(F.lit("GLOBAL").alias("scope_type"), F.lit(None).cast("string").alias("scope_id"))
    place = F.coalesce(one("GUILD", guild), one("CHAT", chat))
    return F.array_compact(F.concat(F.array(one("USER", user)), role, F.array(one("CHANNEL", channel), place, one("PLATFORM", platform), everywhere)))


def resolve(contexts: DataFrame, key: str, records: DataFrame, policy_type: str) -> DataFrame:
    """The record of each context: of the enabled ones of its scopes, the one of the most specific scope,
    then of the highest priority, then the newest. contexts has key, platform and chain. Contexts without
    a record keep null columns, for the caller's default. The join is by equality of scope, so it
    hashes; only matches are ranked."""
    at = contexts.select(key, F.col("platform").alias("c_platform"), F.posexplode("chain").alias("scope_rank", "s"))
    r = records.where((F.col("policy_type") == policy_type) & F.col("enabled"))
    on = (F.col("s.scope_type") == r["scope_type"]) & F.coalesce(F.col("s.scope_id"), F.lit("")).eqNullSafe(F.coalesce(r["scope_id"], F.lit("")))
    on = on & ((r["scope_type"] == "GLOBAL") | r["platform"].isNull() | (r["platform"] == F.col("c_platform")))
    found = at.join(r, on).select(key, "scope_rank", "policy_id", "version", "payload", "priority", "updated_at", r["scope_type"])
    first = Window.partitionBy(key).orderBy("scope_rank", F.desc("priority"), F.desc("updated_at"), "policy_id")
    best = found.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return contexts.select(key).join(best, key, "left")


def as_table(spark: SparkSession, values: dict, key: str, value: str) -> DataFrame:
    """A mapping as a small dimension."""
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], f"{key} {'int' if isinstance(next(iter(values)), int) else 'string'}, {value} double")


def lookup(values: dict, key: Column, default=None) -> Column:
    """values[key] as an expression, or default."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))

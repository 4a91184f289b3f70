"""Routing to automatic handling or a person: one ordered decision table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.functions.arrays import settle
from threadwise.functions.regex import search
from threadwise.operators.intent import (
    LOWERED,
    all_of,
    any_of,
    first_match,
    with_lowered,
)
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK, RulePack

AUTO, ESCALATE = "AUTO_HANDLE", "ESCALATE"
AUTO_RULES = ("how_to_no_evidence", "how_to_weak_evidence", "standard", "other")


@dataclass(frozen=True)
class RoutingPolicy:
    confidence_threshold: float = fixed.CONFIDENCE_THRESHOLD
    retrieval_threshold: float = fixed.RETRIEVAL_THRESHOLD
    require_grounding: bool = True


def risk_pattern(lowered: Column, pack: RulePack = SUPPORT_PACK) -> Column:
    """The first risk pattern that occurs, else null."""
    return F.coalesce(
        *[F.when(search(lowered, p), F.lit(p)) for p in pack.risk_patterns],
        F.lit(None).cast("string"),
    )


def is_risky(lowered: Column, pack: RulePack = SUPPORT_PACK) -> Column:
    """True where any risk pattern occurs, found in a single pass over the text."""
    if not pack.risk_patterns:
        return F.lit(False)
    return search(lowered, "|".join(f"(?:{p})" for p in pack.risk_patterns))


def shipping_exemption(lowered: Column, intent: Column) -> Column:
    """A lost parcel with tracking words is a delivery matter, not a security risk."""
    return (
        (intent == fixed.SHIPPING_INTENT)
        & search(lowered, fixed.SHIPPING_LOSS_PATTERN)
        & search(lowered, fixed.SHIPPING_TRACK_PATTERN)
    )


def risk_rule(lowered: Column) -> Column:
    """Which kind of risk a risky message signals."""
    return first_match(
        [
            (search(lowered, fixed.RISK_COMPROMISED_PATTERN), F.lit("risk_compromised")),
            (search(lowered, fixed.RISK_DUPLICATE_PATTERN), F.lit("risk_duplicate")),
            (search(lowered, fixed.RISK_UNRECOGNISED_PATTERN), F.lit("risk_unrecognised")),
        ],
        F.lit("risk_generic"),
    )


def dead_device(lowered: Column, intent: Column) -> Column:
    """The device stopped responding after an update."""
    return all_of(
        [
            intent.isin(*fixed.DEAD_DEVICE_INTENTS),
            any_of([search(lowered, p) for p in fixed.DEAD_DEVICE_CONTEXT_PATTERNS]),
            search(lowered, fixed.DEAD_DEVICE_SYMPTOM_PATTERN),
        ]
    )


def sensitive_primary(
    intent: Column, intents: Column, pack: RulePack = SUPPORT_PACK
) -> Column:
    """True where the first sensitive intent listed is the primary one."""
    listed = F.when(F.size(intents) > 0, intents).otherwise(F.array(intent))
    sensitive = F.filter(listed, lambda name: name.isin(*pack.sensitive_intents))
    return F.coalesce(F.get(sensitive, F.lit(0)) == intent, F.lit(False))


def sensitive_rule(lowered: Column, intent: Column) -> Column:
    billing = intent == fixed.BILLING_INTENT
    return first_match(
        [
            (
                billing & search(lowered, fixed.BILLING_DUPLICATE_PATTERN),
                F.lit("sensitive_duplicate"),
            ),
            (billing, F.lit("sensitive_billing")),
        ],
        F.lit("sensitive_account"),
    )


def routing_rule(
    lowered: Column, pack: RulePack = SUPPORT_PACK, policy: RoutingPolicy = RoutingPolicy()
) -> Column:
    """Name of the first rule that applies.

    Reads the columns intent, intents, confidence, evidence, best_similarity, answer_supported
    and reply_grounded.
    """
    intent, confidence = F.col("intent"), F.col("confidence")
    risky = is_risky(lowered, pack) & ~shipping_exemption(lowered, intent)
    how_to = (
        (intent == fixed.HOW_TO_INTENT)
        & F.col("answer_supported")
        & (confidence >= policy.confidence_threshold)
    )
    no_evidence = F.size("evidence") == 0
    weak = F.col("best_similarity") < policy.retrieval_threshold
    ungrounded = (
        F.lit(policy.require_grounding)
        & ~F.col("reply_grounded")
        & (intent != fixed.HOW_TO_INTENT)
    )
    return first_match(
        [
            (risky, risk_rule(lowered)),
            (dead_device(lowered, intent), F.lit("dead_device")),
            (sensitive_primary(intent, F.col("intents"), pack), sensitive_rule(lowered, intent)),
            (confidence < policy.confidence_threshold, F.lit("low_confidence")),
            (no_evidence & how_to, F.lit("how_to_no_evidence")),
            (no_evidence, F.lit("no_evidence")),
            (weak & how_to, F.lit("how_to_weak_evidence")),
            (weak, F.lit("weak_evidence")),
            (~F.col("answer_supported"), F.lit("unsupported_answer")),
            (ungrounded, F.lit("ungrounded")),
            (intent.isin(*pack.standard_intents), F.lit("standard")),
        ],
        F.lit("other"),
    )


def routing_reason(rule: Column, intent: Column, grounding_reason: Column) -> Column:
    """The text for a rule; an ungrounded reply reports why, if that is known."""
    cases = [
        (
            rule == "ungrounded",
            F.coalesce(
                F.nullif(grounding_reason, F.lit("")), F.lit(wording.ROUTING_REASONS["ungrounded"])
            ),
        ),
        (rule == "other", F.format_string(wording.ROUTING_REASONS["other"], intent)),
    ]
    cases += [(rule == name, F.lit(text)) for name, text in wording.ROUTING_REASONS.items()]
    return first_match(cases, F.lit(None).cast("string"))


def route(
    messages: DataFrame,
    text: str = "message",
    pack: RulePack = SUPPORT_PACK,
    policy: RoutingPolicy = RoutingPolicy(),
) -> DataFrame:
    """Add ``escalation``: struct of decision, reason and rule."""
    rule = F.col("_rule")
    decision = F.when(rule.isin(*AUTO_RULES), AUTO).otherwise(ESCALATE)
    reason = routing_reason(rule, F.col("intent"), F.col("grounding_reason"))
    ruled = with_lowered(messages, text).withColumn(
        "_rule", routing_rule(F.col(LOWERED), pack, policy)
    )
    return (
        settle(ruled, "_rule")
        .withColumn(
            "escalation",
            F.struct(decision.alias("decision"), reason.alias("reason"), rule.alias("rule")),
        )
        .drop("_rule", LOWERED)
    )

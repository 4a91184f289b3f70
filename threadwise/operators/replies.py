"""Reply drafting from rules and templates, and grounding against retrieved cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwise.functions.arrays import settle
from threadwise.functions.regex import search
from threadwise.functions.text import term_set
from threadwise.operators.intent import LOWERED, all_of, first_match, with_lowered
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK, RulePack


def _null() -> Column:
    return F.lit(None).cast("string")


def known_rule(lowered: Column, intent: Column, pack: RulePack = SUPPORT_PACK) -> Column:
    """Name of the first known-issue rule that applies, else null."""
    cases = []
    for rule in pack.reply_rules:
        conditions = [intent.isin(*rule.intents)] if rule.intents else []
        conditions += [search(lowered, pattern) for pattern in rule.patterns]
        cases.append((all_of(conditions), F.lit(rule.name)))
    return first_match(cases, _null()) if cases else _null()


def known_reply(rule: Column, pack: RulePack = SUPPORT_PACK) -> Column:
    """The fixed reply of a known-issue rule."""
    cases = [(rule == entry.name, F.lit(entry.reply)) for entry in pack.reply_rules]
    return first_match(cases, _null()) if cases else _null()


def template_rule(lowered: Column, intent: Column, pack: RulePack = SUPPORT_PACK) -> Column:
    """Name of the template: the intent's own, the damage template, or the general one."""
    # The damage branch repeats a known-issue rule and so never fires in draft_replies.
    damage = (intent == fixed.DAMAGE_INTENT) & search(lowered, fixed.DAMAGE_PATTERN)
    return first_match(
        [(damage, F.lit("damage")), (intent.isin(*pack.intent_names), intent)],
        F.lit(pack.fallback_intent),
    )


def template_reply(template: Column, pack: RulePack = SUPPORT_PACK) -> Column:
    cases = [(template == "damage", F.lit(wording.DAMAGE_REPLY))] + [
        (template == entry.name, F.lit(entry.template)) for entry in pack.intents
    ]
    return first_match(cases, _null())


def draft_replies(
    classified: DataFrame, text: str = "message", pack: RulePack = SUPPORT_PACK
) -> DataFrame:
    """Add reply, reply_rule, reply_source, answer_supported, support_reason, generation_model."""
    lowered, intent = F.col(LOWERED), F.col("intent")
    known = F.col("known_rule").isNotNull()
    ruled = (
        with_lowered(classified, text)
        .withColumn("known_rule", known_rule(lowered, intent, pack))
        .withColumn("template", template_rule(lowered, intent, pack))
        .drop(LOWERED)
    )
    return (
        settle(ruled, "known_rule", "template")
        .withColumn(
            "reply",
            F.when(known, known_reply(F.col("known_rule"), pack)).otherwise(
                template_reply(F.col("template"), pack)
            ),
        )
        .withColumn("reply_rule", F.when(known, F.col("known_rule")).otherwise(F.col("template")))
        .withColumn("reply_source", F.when(known, "known").otherwise("template"))
        .withColumn("answer_supported", known)
        .withColumn(
            "support_reason",
            F.when(known, wording.SUPPORT_REASONS["known"]).otherwise(
                wording.SUPPORT_REASONS["template"]
            ),
        )
        .withColumn(
            "generation_model",
            F.when(known, fixed.KNOWN_MODEL).otherwise(fixed.TEMPLATE_MODEL),
        )
        .drop("known_rule", "template")
    )


def evidence_terms(evidence: Column) -> Column:
    """Distinct terms of all retrieved queries and replies; the array holds at most k cases."""
    texts = F.transform(
        evidence, lambda case: F.concat_ws(" ", case["initial_query"], case["first_support_reply"])
    )
    return term_set(F.array_join(texts, " "))


def _term_array(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(word) for word in words])


def reply_actions(reply_terms: Column, pack: RulePack = SUPPORT_PACK) -> Column:
    """Names of the action groups that share a term with the reply."""
    named = [
        F.when(F.arrays_overlap(reply_terms, _term_array(words)), F.lit(name))
        for name, words in pack.action_groups.items()
    ]
    return F.array_compact(F.array(*named))


def unsupported_actions(
    actions: Column, terms: Column, pack: RulePack = SUPPORT_PACK
) -> Column:
    """Those of ``actions``, contact aside, for which the evidence has no term."""
    named = [
        F.when(
            F.array_contains(actions, name) & ~F.arrays_overlap(terms, _term_array(words)),
            F.lit(name),
        )
        for name, words in pack.action_groups.items()
        if name != pack.contact_group
    ]
    return F.array_compact(F.array(*named))


def grounding_code(
    evidence: Column, actions: Column, unsupported: Column, pack: RulePack = SUPPORT_PACK
) -> Column:
    """no_evidence, no_action, unsupported_action or supported."""
    return first_match(
        [
            (F.size(evidence) == 0, F.lit("no_evidence")),
            (F.size(F.array_remove(actions, pack.contact_group)) == 0, F.lit("no_action")),
            (F.size(unsupported) > 0, F.lit("unsupported_action")),
        ],
        F.lit("supported"),
    )


def grounding_reason(code: Column) -> Column:
    cases = [(code == key, F.lit(text)) for key, text in wording.GROUNDING_REASONS.items()]
    return first_match(cases, _null())


def ground_replies(
    drafts: DataFrame, pack: RulePack = SUPPORT_PACK, reply: str = "reply"
) -> DataFrame:
    """Add actions, unsupported, grounding, grounded and grounding_reason.

    Needs ``evidence`` with ``initial_query`` and ``first_support_reply`` per case.
    """
    checked = (
        drafts.withColumn("reply_terms", term_set(F.coalesce(F.col(reply), F.lit(""))))
        .withColumn("evidence_terms", evidence_terms(F.col("evidence")))
        .withColumn("actions", reply_actions(F.col("reply_terms"), pack))
        .withColumn(
            "unsupported",
            unsupported_actions(F.col("actions"), F.col("evidence_terms"), pack),
        )
        .withColumn(
            "grounding",
            grounding_code(F.col("evidence"), F.col("actions"), F.col("unsupported"), pack),
        )
        .drop("reply_terms", "evidence_terms")
    )
    return (
        settle(checked, "actions", "unsupported", "grounding")
        .withColumn("grounded", F.col("grounding") == "supported")
        .withColumn("grounding_reason", grounding_reason(F.col("grounding")))
    )


def generate_replies(
    classified: DataFrame, text: str = "message", pack: RulePack = SUPPORT_PACK
) -> DataFrame:
    """Draft and ground: the seven reply columns plus the rule and action columns."""
    grounded = ground_replies(draft_replies(classified, text, pack), pack)
    return grounded.withColumn("historical_grounded", F.col("grounded"))

"""The rule pack: everything a brand configures, as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording


@dataclass(frozen=True)
class Intent:
    name: str
    default_action: str
    keywords: tuple[str, ...]
    description: str = ""
    label: str = ""
    template: str = ""


@dataclass(frozen=True)
class Override:
    """Sets the intent outright when every pattern occurs."""

    name: str
    intent: str
    patterns: tuple[str, ...]
    reasoning: str = ""


@dataclass(frozen=True)
class Settled:
    """Messages of these intents with any of the patterns (or with none given) need no model."""

    intents: tuple[str, ...]
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ReplyRule:
    """A fixed reply for an intent (empty = any) when every pattern occurs."""

    name: str
    intents: tuple[str, ...]
    patterns: tuple[str, ...]
    reply: str


@dataclass(frozen=True)
class RulePack:
    intents: tuple[Intent, ...]
    fallback_intent: str
    overrides: tuple[Override, ...] = ()
    settled: tuple[Settled, ...] = ()
    reply_rules: tuple[ReplyRule, ...] = ()
    action_groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    contact_group: str = fixed.CONTACT_GROUP
    risk_patterns: tuple[str, ...] = ()
    sensitive_intents: tuple[str, ...] = ()
    standard_intents: tuple[str, ...] = ()

    @property
    def intent_names(self) -> list[str]:
        return [intent.name for intent in self.intents]

    def intent(self, name: str) -> Intent:
        return next(intent for intent in self.intents if intent.name == name)


SUPPORT_PACK = RulePack(
    intents=tuple(
        Intent(
            name,
            action,
            keywords,
            wording.INTENT_DESCRIPTIONS[name],
            fixed.LABELS[name],
            wording.TEMPLATE_REPLIES[name],
        )
        for name, action, keywords in fixed.INTENTS
    ),
    fallback_intent=fixed.FALLBACK_INTENT,
    overrides=tuple(
        Override(name, intent, patterns, wording.OVERRIDE_REASONING[name])
        for name, intent, patterns in fixed.OVERRIDES
    ),
    settled=tuple(Settled(*entry) for entry in fixed.SETTLED),
    reply_rules=tuple(
        ReplyRule(name, intents, patterns, wording.KNOWN_REPLIES[name])
        for name, intents, patterns in fixed.REPLY_RULES
    ),
    action_groups=fixed.ACTION_GROUPS,
    risk_patterns=fixed.RISK_PATTERNS,
    sensitive_intents=fixed.SENSITIVE_INTENTS,
    standard_intents=fixed.STANDARD_INTENTS,
)

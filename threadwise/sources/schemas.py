"""Explicit schemas for every table the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_L = T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TWEETS = _struct(
    tweet_id=_S, author_id=_S, inbound=_B, created_at=_S, text=_S,
    response_tweet_id=_S, in_response_to_tweet_id=_S,
)

CONVERSATIONS = _struct(
    conversation_id=_S, root_tweet_id=_S, customer_id=_S, num_turns=_I, initial_query=_S,
    first_support_reply=_S, has_support_reply=_B, full_dialogue=_S, dialogue_head=_S,
    dialogue_chars=_L,
)

DIALOGUE_PARTS = _struct(root_tweet_id=_S, dialogue_part=_I, dialogue=_S)

GOLDEN = _struct(
    conversation_id=_S, message=_S, intent=_S, expected_action=_S, first_support_reply=_S,
    label_source=_S, review_status=_S, notes=_S,
)

DIMENSIONS = ("correctness", "groundedness", "helpfulness", "tone", "hallucination")

# Ratings are read as text so that blanks and fractions reach the validator unchanged.
HUMAN_RATINGS = _struct(
    conversation_id=_S, message=_S, reply=_S, **{name: _S for name in DIMENSIONS}
)

JUDGED_RESULTS = _struct(
    conversation_id=_S, message=_S, true_intent=_S, pred_intent=_S, confidence=_D,
    true_action=_S, pred_action=_S, escalation_reason=_S, reply=_S, reply_grounded=_B,
    historical_grounded=_B, answer_supported=_B, support_reason=_S, grounding_reason=_S,
    generation_model=_S, evidence=_S,
    **{f"judge_{name}": _I for name in DIMENSIONS}, judge_reasoning=_S,
)

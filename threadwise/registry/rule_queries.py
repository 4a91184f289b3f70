"""Intent, replies, routing, triage and prompt tables (F, G, H, I, M)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from threadwise.functions.text import term_set
from threadwise.operators import baselines, intent, model_tables, replies, routing
from threadwise.operators.intent import LOWERED, with_lowered
from threadwise.plans import triage as plan
from threadwise.registry import inputs
from threadwise.registry import sqltext as sql
from threadwise.registry.catalog import query
from threadwise.registry.inputs import MESSAGES, SUPPORT_CONVERSATIONS
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK
from threadwise.session import cut_lineage

_SCORED = sql.with_(MESSAGES, sql.scored("messages", "msg_id", "message"))
_CLASSIFIED = sql.with_(sql.CLASSIFIED)
_DRAFTED = sql.with_(sql.CLASSIFIED, sql.DRAFTED)
_TRIAGED = sql.with_(sql.triage_ctes())
_GENERAL = sql.lit(SUPPORT_PACK.fallback_intent)


def _keywords(spark, sf_dir):
    return intent.classify_by_keywords(inputs.messages(spark, sf_dir))


def _classified(spark, sf_dir):
    return intent.classify(inputs.messages(spark, sf_dir))


# --- F: intent -----------------------------------------------------------------------------------

@query(
    _SCORED
    + """
SELECT m.msg_id, t.intent, coalesce(h.hits, 0) AS hits
FROM messages m JOIN taxonomy t ON TRUE
LEFT JOIN hits h ON h.msg_id = m.msg_id AND h.intent = t.intent"""
)
def f2_keyword_hits(spark, sf_dir):
    return intent.hit_table(inputs.messages(spark, sf_dir)).withColumn(
        "hits", F.col("hits").cast("long")
    )


@query(_SCORED + "\nSELECT msg_id, intent, best FROM best")
def f3_primary_intent(spark, sf_dir):
    hit = _keywords(spark, sf_dir).where("best_hits > 0")
    return hit.select("msg_id", "intent", F.col("best_hits").cast("long").alias("best"))


@query(_SCORED + "\nSELECT msg_id, intents FROM best")
def f4_multi_intent(spark, sf_dir):
    hit = _keywords(spark, sf_dir).where("best_hits > 0")
    return hit.select("msg_id", F.array_join("intents", "|").alias("intents"))


@query(
    _SCORED
    + f"""
SELECT msg_id, CASE best WHEN 1 THEN 0.63 WHEN 2 THEN 0.71 WHEN 3 THEN 0.79 WHEN 4 THEN 0.87
       ELSE 0.88 END::DOUBLE AS confidence, {sql.hit_reasoning("best")} AS reasoning
FROM best"""
)
def f5_confidence(spark, sf_dir):
    hit = _keywords(spark, sf_dir).where("best_hits > 0")
    return hit.select("msg_id", "confidence", "reasoning")


@query(
    _SCORED
    + f"""
SELECT m.msg_id, coalesce(b.intent, {_GENERAL}) AS intent, b.intent IS NULL AS no_hit
FROM messages m LEFT JOIN best b USING (msg_id)"""
)
def f6_fallback_intent(spark, sf_dir):
    return _keywords(spark, sf_dir).select(
        "msg_id", "intent", (F.col("best_hits") == 0).alias("no_hit")
    )


def _override_sql(name: str) -> str:
    rule = next(r for r in SUPPORT_PACK.overrides if r.name == name)
    return (
        sql.with_(MESSAGES, f"lowered AS (SELECT *, {sql.ascii_words('message')} AS lo FROM messages)")
        + f"\nSELECT msg_id, {sql.found_all('lo', rule.patterns)} AS applies FROM lowered"
    )


def _override(spark, sf_dir, name):
    pack = SUPPORT_PACK
    rule = next(r for r in pack.overrides if r.name == name)
    lowered = with_lowered(inputs.messages(spark, sf_dir), "message")
    alone = replace(pack, overrides=(rule,))
    applies = intent.override_name(F.col(LOWERED), alone).isNotNull()
    return lowered.select("msg_id", applies.alias("applies"))


@query(_override_sql("how_to_request"))
def f7_how_to_override(spark, sf_dir):
    return _override(spark, sf_dir, "how_to_request")


@query(_override_sql("disputed_charge"))
def f8_disputed_charge_override(spark, sf_dir):
    return _override(spark, sf_dir, "disputed_charge")


@query(_CLASSIFIED + "\nSELECT msg_id, needs_model FROM classified")
def f9_needs_model(spark, sf_dir):
    return _classified(spark, sf_dir).select("msg_id", "needs_model")


@query(
    _CLASSIFIED
    + "\nSELECT msg_id, intent, intents, confidence, reasoning, override_name FROM classified"
)
def f9_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select(
        "msg_id",
        "intent",
        F.array_join("intents", "|").alias("intents"),
        "confidence",
        "reasoning",
        F.col("override").alias("override_name"),
    )


@query(
    _SCORED
    + f"""
SELECT m.msg_id, coalesce(b.intent, {_GENERAL}) AS weak_label
FROM messages m LEFT JOIN best b USING (msg_id)"""
)
def f10_weak_label(spark, sf_dir):
    return intent.weak_label(inputs.messages(spark, sf_dir)).select("msg_id", "weak_label")


@query(
    _SCORED
    + f"""
, labelled AS (
  SELECT m.msg_id, coalesce(b.intent, {_GENERAL}) AS label
  FROM messages m LEFT JOIN best b USING (msg_id)),
majority AS (
  SELECT label FROM labelled GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT msg_id, (SELECT label FROM majority) AS predicted FROM messages"""
)
def f11_majority_baseline(spark, sf_dir):
    messages = inputs.messages(spark, sf_dir)
    training = intent.weak_label(messages, label="label")
    return baselines.predict_majority(messages, training).select("msg_id", "predicted")


_LABELLED = f"""labelled AS (
  SELECT m.msg_id, coalesce(b.intent, {_GENERAL}) AS label
  FROM messages m LEFT JOIN best b USING (msg_id))"""
_MESSAGE_TERMS = sql.tfidf("messages", "msg_id", "message", fixed.BASELINE_MAX_FEATURES)


@query(
    sql.recursive(
        _SCORED + ",\n" + ",\n".join(
            [_LABELLED, _MESSAGE_TERMS, sql.linear_fit([x.name for x in SUPPORT_PACK.intents])]
        )
    )
    + "\nSELECT msg_id, predicted FROM linear"
)
def f12_linear_baseline(spark, sf_dir):
    messages = inputs.messages(spark, sf_dir)
    model = baselines.fit_text_classifier(intent.weak_label(messages, label="label"))
    return model.predict(messages)


@query(
    _SCORED
    + f""",
{_LABELLED},
{_MESSAGE_TERMS},
held AS (
  SELECT label, term, sum(w) AS held FROM labelled JOIN doc_weights USING (msg_id) GROUP BY ALL
  UNION ALL
  SELECT label, NULL, count(*) FROM labelled GROUP BY label),
cells AS (
  SELECT label, term FROM (SELECT DISTINCT label FROM labelled),
         (SELECT term FROM vocab UNION ALL SELECT NULL))
SELECT c.label, c.term, round(coalesce(h.held, 0), 5) AS held, TRUE AS vanishes
FROM cells c LEFT JOIN held h ON c.label = h.label AND c.term IS NOT DISTINCT FROM h.term"""
)
def f12_optimality(spark, sf_dir):
    """Whether the fitted model is the one its training rows ask for, coefficient by coefficient."""
    training = intent.weak_label(inputs.messages(spark, sf_dir), label="label")
    training = cut_lineage(training.select("msg_id", "message", "label"))
    model = baselines.fit_text_classifier(training)
    return (
        model.gradient(training)
        .join(model.vocab.select("term_id", "term"), "term_id", "left")
        .select(
            "label",
            "term",
            F.round("held", 5).alias("held"),
            (F.abs("gradient") < 1e-5).alias("vanishes"),
        )
    )


@query(
    rf"""
SELECT word, count(*) AS occurrences
FROM (SELECT unnest(regexp_split_to_array(
        regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{sql.SPACES[1:-1]}]', '', 'g'),
        '{sql.SPACES}+')) AS word FROM documents)
WHERE length(word) > 3 GROUP BY word ORDER BY occurrences DESC, word LIMIT 20"""
)
def f13_top_words(spark, sf_dir):
    return intent.top_words(inputs.texts(spark, sf_dir, "documents"), "text")


@query(sql.with_(SUPPORT_CONVERSATIONS) + "\nSELECT count(initial_query) AS queries FROM support_conversations")
def f14_query_count(spark, sf_dir):
    return intent.query_count(inputs.support_conversations(spark, sf_dir))


_DISPLAY = sql.case(
    [
        (
            f"intent = 'payment_billing_issue' AND {sql.found('lo', fixed.DUPLICATE_CHARGE_LABEL_PATTERN)}",
            sql.lit(fixed.DUPLICATE_CHARGE_LABEL),
        )
    ],
    "(SELECT label FROM taxonomy t WHERE t.intent = c.intent)",
)


@query(_CLASSIFIED + f"\nSELECT msg_id, {_DISPLAY} AS display_label FROM classified c")
def f15_display_label(spark, sf_dir):
    return intent.display_label(_classified(spark, sf_dir)).select("msg_id", "display_label")


# --- G: replies ------------------------------------------------------------------------------------

def _drafted(spark, sf_dir):
    return replies.draft_replies(_classified(spark, sf_dir))


@query(
    _DRAFTED
    + "\nSELECT msg_id, reply_rule, reply FROM drafted WHERE reply_source = 'known'"
)
def g1_known_replies(spark, sf_dir):
    return _drafted(spark, sf_dir).where("reply_source = 'known'").select(
        "msg_id", "reply_rule", "reply"
    )


@query(
    _CLASSIFIED + ",\n" + sql.TEMPLATES
    + f"""
SELECT msg_id, CASE WHEN c.intent = 'device_hardware_issue' AND {sql.found("lo", fixed.DAMAGE_PATTERN)}
       THEN {sql.lit(wording.DAMAGE_REPLY)} ELSE t.reply END AS reply
FROM classified c LEFT JOIN templates t USING (intent)"""
)
def g2_template_replies(spark, sf_dir):
    classified = with_lowered(_classified(spark, sf_dir), "message")
    template = replies.template_rule(F.col(LOWERED), F.col("intent"))
    return classified.withColumn("template", template).select(
        "msg_id", replies.template_reply(F.col("template")).alias("reply")
    )


@query(
    _DRAFTED
    + """
SELECT msg_id, reply_source, answer_supported, support_reason, generation_model FROM drafted"""
)
def g4_reply_provenance(spark, sf_dir):
    return _drafted(spark, sf_dir).select(
        "msg_id", "reply_source", "answer_supported", "support_reason", "generation_model"
    )


@query(
    _TRIAGED
    + """
SELECT m.msg_id, coalesce(string_agg(e.term, '|' ORDER BY e.term), '') AS terms
FROM messages m LEFT JOIN evidence_terms e USING (msg_id) GROUP BY m.msg_id"""
)
def g5_evidence_terms(spark, sf_dir):
    terms = F.sort_array(replies.evidence_terms(F.col("evidence")))
    return inputs.triaged_with_cases(spark, sf_dir).select(
        "msg_id", F.array_join(terms, "|").alias("terms")
    )


@query(
    _DRAFTED + ",\n" + sql.GROUPS
    + """,
reply_terms AS (
  SELECT msg_id, unnest(regexp_extract_all(lower(reply), '[a-z][a-z'']+')) AS term FROM drafted)
SELECT d.msg_id, coalesce((SELECT string_agg(DISTINCT g.grp, '|' ORDER BY g.grp)
  FROM reply_terms r JOIN action_terms g USING (term)
  WHERE r.msg_id = d.msg_id AND length(r.term) >= 4), '') AS actions
FROM drafted d"""
)
def g6_reply_actions(spark, sf_dir):
    actions = replies.reply_actions(term_set(F.col("reply")))
    return _drafted(spark, sf_dir).select(
        "msg_id", F.array_join(F.sort_array(actions), "|").alias("actions")
    )


@query(
    _TRIAGED
    + f"\nSELECT msg_id, grounding, grounding = 'supported' AS grounded, {sql.GROUNDING_REASON} "
    "AS grounding_reason FROM grounded"
)
def g7_grounding(spark, sf_dir):
    drafts = inputs.triaged_with_cases(spark, sf_dir).select("msg_id", "reply", "evidence")
    grounded = replies.ground_replies(drafts)
    return grounded.select("msg_id", "grounding", "grounded", "grounding_reason")


@query(
    sql.whole_texts(
        _TRIAGED
        + f"""
SELECT msg_id, reply, grounding = 'supported' AS grounded, grounding = 'supported' AS historical_grounded,
       answer_supported, support_reason, {sql.GROUNDING_REASON} AS grounding_reason, generation_model
FROM grounded"""
    )
)
def g8_generate_replies(spark, sf_dir):
    triaged = inputs.triaged_with_cases(spark, sf_dir, whole=True)
    attached = triaged.select("msg_id", "message", "evidence")
    return replies.generate_replies(intent.classify(attached)).select(
        "msg_id", "reply", "grounded", "historical_grounded", "answer_supported",
        "support_reason", "grounding_reason", "generation_model",
    )


# --- H: routing --------------------------------------------------------------------------------------

_RISKS = (
    sql.CLASSIFIED + ",\n" + sql.RISK
    + f""",
risked AS (
  SELECT *, {sql.RISK_HIT} AS risk, {sql.EXEMPT} AS exempt, {sql.DEAD} AS dead,
         {sql.RISK_RULE} AS risk_kind, {sql.SENSITIVE} AS sensitive, {sql.SENSITIVE_RULE} AS sensitive_kind
  FROM classified)"""
)


def _lowered(spark, sf_dir):
    return with_lowered(_classified(spark, sf_dir), "message")


@query(sql.with_(_RISKS) + "\nSELECT msg_id, risk FROM risked")
def h1_risk_pattern(spark, sf_dir):
    return _lowered(spark, sf_dir).select(
        "msg_id", routing.risk_pattern(F.col(LOWERED)).alias("risk")
    )


@query(sql.with_(_RISKS) + "\nSELECT msg_id, intent, exempt FROM risked")
def h2_shipping_exemption(spark, sf_dir):
    return _lowered(spark, sf_dir).select(
        "msg_id", "intent",
        routing.shipping_exemption(F.col(LOWERED), F.col("intent")).alias("exempt"),
    )


@query(
    sql.with_(_RISKS)
    + "\nSELECT msg_id, risk_kind FROM risked WHERE risk IS NOT NULL AND NOT exempt"
)
def h3_risk_reason(spark, sf_dir):
    lowered = F.col(LOWERED)
    risky = routing.is_risky(lowered) & ~routing.shipping_exemption(lowered, F.col("intent"))
    return _lowered(spark, sf_dir).where(risky).select(
        "msg_id", routing.risk_rule(lowered).alias("risk_kind")
    )


@query(sql.with_(_RISKS) + "\nSELECT msg_id, dead FROM risked")
def h4_dead_device(spark, sf_dir):
    return _lowered(spark, sf_dir).select(
        "msg_id", routing.dead_device(F.col(LOWERED), F.col("intent")).alias("dead")
    )


@query(sql.with_(_RISKS) + "\nSELECT msg_id, sensitive_kind FROM risked WHERE sensitive")
def h5_sensitive_intent(spark, sf_dir):
    intent_column, lowered = F.col("intent"), F.col(LOWERED)
    return (
        _lowered(spark, sf_dir)
        .where(routing.sensitive_primary(intent_column, F.col("intents")))
        .select("msg_id", routing.sensitive_rule(lowered, intent_column).alias("sensitive_kind"))
    )


def _rule_query(name: str, rules: tuple[str, ...]) -> None:
    """Messages a group of routing rules decides, with decision and reason."""
    chosen = sql.in_list("rule", rules)

    def run(spark, sf_dir):
        result = inputs.triaged(spark, sf_dir).select("msg_id", "escalation.*")
        return result.where(F.col("rule").isin(*rules))

    run.__name__ = name
    query(_TRIAGED + f"\nSELECT msg_id, decision, reason, rule FROM routed WHERE {chosen}")(run)


_rule_query("h6_low_confidence", ("low_confidence",))
_rule_query("h7_no_evidence", ("how_to_no_evidence", "no_evidence"))
_rule_query("h8_weak_evidence", ("how_to_weak_evidence", "weak_evidence"))
_rule_query("h9_unsupported_answer", ("unsupported_answer",))
_rule_query("h10_ungrounded", ("ungrounded",))
_rule_query("h11_auto_handled", ("standard", "other"))


@query(_TRIAGED + "\nSELECT msg_id, decision, reason, rule FROM routed")
def h12_route(spark, sf_dir):
    columns = [
        "msg_id", "message", "intent", "intents", "confidence", "evidence", "best_similarity",
        "answer_supported", "reply_grounded", "grounding_reason",
    ]
    routed = routing.route(inputs.triaged(spark, sf_dir).select(*columns))
    return routed.select("msg_id", "escalation.decision", "escalation.reason", "escalation.rule")


# --- I: triage ---------------------------------------------------------------------------------------

_TRIAGE_COLUMNS = """msg_id, message, intent, intents, confidence, reasoning, cases,
       top AS best_similarity, reply, reply_rule, answer_supported, support_reason, grounding,
       grounding = 'supported' AS reply_grounded, actions, generation_model, decision, reason, rule"""


@query(sql.whole_texts(_TRIAGED + f"\nSELECT {_TRIAGE_COLUMNS} FROM routed"))
def i1_triage(spark, sf_dir):
    messages = inputs.messages(spark, sf_dir, whole=True)
    result = plan.triage(messages, inputs.support_index(spark, sf_dir, whole=True))
    return result.select(
        "msg_id", "message", "intent", F.array_join("intents", "|").alias("intents"), "confidence",
        "reasoning", F.size("evidence").cast("long").alias("cases"), "best_similarity", "reply",
        "reply_rule", "answer_supported", "support_reason", "grounding", "reply_grounded",
        F.array_join(F.sort_array("actions"), "|").alias("actions"), "generation_model",
        "escalation.decision", "escalation.reason", "escalation.rule",
    )


@query(
    sql.whole_texts(
        _TRIAGED
        + f"""
SELECT msg_id, message, {_DISPLAY} AS display_label, confidence, cases AS evidence_count,
       round(top, 3) AS top_similarity, replace(decision, '_', '-') AS decision,
       CASE WHEN intent = 'device_hardware_issue' AND decision = 'AUTO_HANDLE'
            THEN {sql.lit(wording.REPORT_HARDWARE_REASON)} ELSE reason END AS reason,
       reply, grounding = 'supported' AS historical_grounded, grounding_reason, answer_supported,
       support_reason,
       coalesce((SELECT string_agg(concat('Customer: ', left(e.initial_query, 180), chr(10),
                 'Support: ', left(e.first_support_reply, 180)), chr(10) ORDER BY e.rank)
                 FROM evidence e WHERE e.msg_id = c.msg_id AND e.rank <= 3),
                'No past case was retrieved.') AS evidence_text
FROM routed c"""
    )
)
def i2_triage_report(spark, sf_dir):
    return plan.triage_report(inputs.triaged_with_cases(spark, sf_dir, whole=True))


# --- M: prompts ----------------------------------------------------------------------------------------

def _filled(template: str, **values: str) -> str:
    """A prompt template as a SQL concatenation."""
    text = sql.lit(template.replace("{{", "{").replace("}}", "}"))
    for name, value in values.items():
        text = text.replace("{" + name + "}", "' || " + value + " || '")
    return text


def _cases(block: str, empty: str, most: str = "") -> str:
    """The past cases of message ``c`` as one text."""
    return (
        f"coalesce((SELECT string_agg({block}, {sql.lit(wording.CASE_SEPARATOR)} ORDER BY e.rank) "
        f"FROM evidence e WHERE e.msg_id = c.msg_id {most}), {sql.lit(empty)})"
    )


_CASES = _cases(
    _filled(
        wording.CASE_BLOCK,
        rank="CAST(e.rank AS VARCHAR)",
        score="printf('%.3f', round(e.similarity_score, 3))",
        question="e.initial_query",
        answer="e.first_support_reply",
        cut=f"CASE WHEN length(e.dialogue_head) > 300 THEN {sql.lit(wording.CASE_CUT_MARK)} ELSE '' END",
        thread="left(e.dialogue_head, 300)",
    ),
    wording.NO_EVIDENCE_BLOCK,
)
_JUDGE_CASES = _cases(
    _filled(
        wording.JUDGE_CASE_BLOCK,
        rank="CAST(e.rank AS VARCHAR)",
        question="left(e.initial_query, 200)",
        answer="left(e.first_support_reply, 200)",
    ),
    wording.JUDGE_NO_EVIDENCE_BLOCK,
    "AND e.rank <= 3",
)
_TAXONOMY_LINES = sql.lit(
    "\n".join(f'  - "{name}": {text}' for name, text in wording.INTENT_DESCRIPTIONS.items())
)


@query(
    _CLASSIFIED
    + "\nSELECT msg_id, "
    + _filled(wording.INTENT_PROMPT, taxonomy=_TAXONOMY_LINES, message="message")
    + " AS prompt FROM classified WHERE needs_model"
)
def m1_intent_prompts(spark, sf_dir):
    return model_tables.intent_prompts(_classified(spark, sf_dir))


@query(_TRIAGED + f"\nSELECT msg_id, {_CASES} AS block FROM messages c")
def m2_evidence_block(spark, sf_dir):
    return inputs.triaged_with_dialogues(spark, sf_dir).select(
        "msg_id", model_tables.evidence_block(F.col("evidence")).alias("block")
    )


@query(
    _TRIAGED
    + "\nSELECT msg_id, "
    + _filled(wording.REPLY_PROMPT, evidence=_CASES, message="message", intent="intent")
    + " AS prompt FROM routed c WHERE reply_source <> 'known'"
)
def m3_reply_prompts(spark, sf_dir):
    return model_tables.reply_prompts(inputs.triaged_with_dialogues(spark, sf_dir))


@query(
    _TRIAGED
    + "\nSELECT msg_id, "
    + _filled(wording.GROUNDING_PROMPT, evidence=_CASES, reply="reply")
    + " AS prompt FROM routed c WHERE cases > 0"
)
def m3_grounding_prompts(spark, sf_dir):
    return model_tables.grounding_prompts(inputs.triaged_with_dialogues(spark, sf_dir))


@query(
    sql.whole_texts(
        _TRIAGED
        + "\nSELECT msg_id, "
        + _filled(wording.JUDGE_PROMPT, message="message", evidence=_JUDGE_CASES, reply="reply")
        + " AS prompt FROM routed c"
    )
)
def m4_judge_prompts(spark, sf_dir):
    return model_tables.judge_prompts(inputs.triaged_with_cases(spark, sf_dir, whole=True))

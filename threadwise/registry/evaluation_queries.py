"""Evaluation sets, metrics, reply scores and rater agreement (J, K, L), and the stream (S)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadwise.operators import agreement, baselines, golden, intent, metrics, quality
from threadwise.plans import evaluate as plan
from threadwise.registry import inputs
from threadwise.registry import sqltext as sql
from threadwise.registry.catalog import query
from threadwise.registry.inputs import MESSAGES, PROBLEMS, SUPPORT_CONVERSATIONS
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK
from threadwise.session import cut_lineage, shared_folder
from threadwise.sources import schemas, tables
from threadwise.sources.schemas import DIMENSIONS
from threadwise.streaming.triage_stream import read_messages, start_triage

# --- J: evaluation sets ---------------------------------------------------------------------------

_QUERIES = f"""support_records AS (
  SELECT conversation_id, initial_query, first_support_reply FROM support_conversations),
eligible AS (SELECT * FROM support_records WHERE length(initial_query) > 15)"""
_LABELLED = (
    sql.with_(SUPPORT_CONVERSATIONS, _QUERIES,
              sql.scored("eligible", "conversation_id", "initial_query"))
    + """,
labelled AS (
  SELECT e.*, coalesce(b.intent, 'other_general') AS weak_label
  FROM eligible e LEFT JOIN best b USING (conversation_id)),
quotas AS (SELECT intent, default_action, 18 + CASE WHEN ord < 2 THEN 1 ELSE 0 END AS quota FROM taxonomy),
drawn AS (
  SELECT l.*, row_number() OVER (PARTITION BY weak_label
           ORDER BY md5(concat('42:', CAST(conversation_id AS VARCHAR))), conversation_id) AS place
  FROM labelled l),
sampled AS (
  SELECT d.*, q.default_action FROM drawn d JOIN quotas q ON q.intent = d.weak_label
  WHERE place <= quota),
golden AS (
  SELECT conversation_id, initial_query AS message, weak_label AS intent,
         default_action AS expected_action, first_support_reply,"""
    + f"""
         {sql.lit(wording.GOLDEN_LABEL_SOURCE)} AS label_source,
         {sql.lit(wording.GOLDEN_REVIEW_STATUS)} AS review_status, {sql.lit(wording.GOLDEN_NOTES)} AS notes
  FROM sampled)"""
)


def _conversations(spark, sf_dir):
    return inputs.support_conversations(spark, sf_dir)


def _labelled(spark, sf_dir):
    return intent.weak_label(
        golden.eligible_queries(_conversations(spark, sf_dir)), "initial_query"
    )


def _golden(spark, sf_dir):
    return golden.golden_set(_conversations(spark, sf_dir))


@query(
    sql.with_(SUPPORT_CONVERSATIONS, _QUERIES) + "\nSELECT conversation_id, initial_query FROM eligible"
)
def j1_eligible_queries(spark, sf_dir):
    eligible = golden.eligible_queries(_conversations(spark, sf_dir))
    return eligible.select("conversation_id", "initial_query")


@query(_LABELLED + "\nSELECT conversation_id, weak_label FROM labelled")
def j2_weak_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("conversation_id", "weak_label")


@query(
    _LABELLED
    + """
SELECT weak_label AS intent, count(*) AS available, max(quota) AS quota,
       least(count(*), max(quota)) AS drawn
FROM labelled JOIN quotas ON intent = weak_label GROUP BY weak_label"""
)
def j3_quotas(spark, sf_dir):
    return golden.quota_table(_labelled(spark, sf_dir))


@query(_LABELLED + "\nSELECT conversation_id, weak_label FROM sampled")
def j4_stratified_sample(spark, sf_dir):
    sample = golden.stratified_sample(_labelled(spark, sf_dir))
    return sample.select("conversation_id", "weak_label")


_SHARES = golden.quotas(110)


@query(
    sql.with_(MESSAGES, sql.scored("messages", "msg_id", "message"))
    + """,
labelled AS (
  SELECT m.msg_id, coalesce(b.intent, 'other_general') AS weak_label
  FROM messages m LEFT JOIN best b USING (msg_id)),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY weak_label
           ORDER BY md5(concat('42:', CAST(msg_id AS VARCHAR))), msg_id) AS place FROM labelled)
SELECT msg_id, weak_label FROM drawn WHERE place <= 10"""
)
def j4_histogram_sample(spark, sf_dir):
    """The way large quotas are drawn, here with small ones, so that some labels exceed theirs."""
    labelled = intent.weak_label(inputs.messages(spark, sf_dir)).select("msg_id", "weak_label")
    return golden.histogram_sample(labelled, _SHARES, "msg_id")


@query(_LABELLED + "\nSELECT * FROM golden")
def j5_golden_set(spark, sf_dir):
    return _golden(spark, sf_dir)


@query(_LABELLED + "\nSELECT intent, count(*) AS rows FROM golden GROUP BY intent")
def j6_intent_breakdown(spark, sf_dir):
    return golden.intent_breakdown(_golden(spark, sf_dir))


# A set with defects: the problem phrase number decides which rows break which rule.
_DEFECTS = MESSAGES + f""",
defects AS (
  SELECT concat('c', CAST(conv_id AS VARCHAR)) AS conversation_id, message,
         CASE WHEN contains(message, 'battery') THEN 'unheard_of' ELSE 'other_general' END AS intent,
         CASE WHEN contains(message, 'storage') THEN 'IGNORE'
              WHEN contains(message, 'charge') THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS expected_action,
         'manual' AS label_source,
         CASE WHEN contains(message, 'phone') THEN 'needs_review' ELSE 'reviewed' END AS review_status
  FROM messages)"""


def _defects(spark, sf_dir):
    text = F.col("message")
    return inputs.messages(spark, sf_dir).select(
        F.concat(F.lit("c"), "conv_id").alias("conversation_id"),
        "message",
        F.when(F.contains(text, F.lit("battery")), "unheard_of").otherwise("other_general").alias("intent"),
        F.when(F.contains(text, F.lit("storage")), "IGNORE")
        .when(F.contains(text, F.lit("charge")), "ESCALATE")
        .otherwise("AUTO_HANDLE")
        .alias("expected_action"),
        F.lit("manual").alias("label_source"),
        F.when(F.contains(text, F.lit("phone")), "needs_review").otherwise("reviewed").alias("review_status"),
    )


@query(
    sql.with_(_DEFECTS)
    + f"""
SELECT 'row_count' AS "check", count(*) AS value,
       CASE WHEN count(*) BETWEEN 150 AND 250 THEN 0 ELSE 1 END AS violations FROM defects
UNION ALL SELECT 'unique_id', count(DISTINCT conversation_id), count(*) - count(DISTINCT conversation_id) FROM defects
UNION ALL SELECT 'known_intent', count(*) FILTER (intent <> 'unheard_of'),
       count(*) FILTER (intent = 'unheard_of') FROM defects
UNION ALL SELECT 'known_action', count(*) FILTER (expected_action <> 'IGNORE'),
       count(*) FILTER (expected_action = 'IGNORE') FROM defects
UNION ALL SELECT 'reviewed', count(*) FILTER (review_status = 'reviewed'),
       count(*) FILTER (review_status <> 'reviewed') FROM defects
UNION ALL SELECT 'distinct_intents', count(DISTINCT intent), 0 FROM defects"""
)
def j7_golden_checks(spark, sf_dir):
    return golden.golden_checks(_defects(spark, sf_dir))


@query(
    f"""
SELECT doc_id FROM documents
ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 100"""
)
def j8_training_sample(spark, sf_dir):
    documents = inputs.read(spark, sf_dir, "documents").select("doc_id")
    return golden.bounded_sample(documents, 100, "doc_id")


# --- K: metrics ---------------------------------------------------------------------------------------

# The truth of a message is the intent of its problem phrase; the prediction is the classifier's.
_TRUTHS = {
    "battery": "device_hardware_issue", "update": "software_update_issue",
    "storage": "device_storage_issue", "how": "device_how_to",
    "password": "account_appleid_issue", "charge": "payment_billing_issue",
    "card": "card_atm_issue", "subscription": "subscription_services",
    "app": "app_store_issue", "delivery": "order_shipping_issue",
}


def _truth_of(phrase: str) -> str:
    words = phrase.split()
    return next((name for word, name in _TRUTHS.items() if word in words), "other_general")


PHRASE_TRUTHS = tuple(_truth_of(phrase) for phrase in PROBLEMS)
_PREDICTIONS = sql.CLASSIFIED + f""",
{sql.rows("truths", "pid, truth", list(enumerate(PHRASE_TRUTHS)))},
predictions AS (
  SELECT c.msg_id, t.truth, c.intent AS predicted
  FROM classified c JOIN truths t ON t.pid = (c.conv_id * 31 + c.msg_id - c.conv_id * 100) % {len(PROBLEMS)})"""
_LABELS = """labels_seen AS (
  SELECT truth AS label FROM predictions UNION SELECT predicted FROM predictions),
per_label AS (
  SELECT l.label,
         (SELECT count(*) FROM predictions WHERE truth = l.label AND predicted = l.label) AS tp,
         (SELECT count(*) FROM predictions WHERE predicted = l.label) AS claimed,
         (SELECT count(*) FROM predictions WHERE truth = l.label) AS support
  FROM labels_seen l),
prf AS (
  SELECT label, support, CASE WHEN claimed = 0 THEN 0.0 ELSE tp / claimed END AS p,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r,
         CASE WHEN claimed + support = 0 THEN 0.0 ELSE 2 * tp / (claimed + support) END AS f
  FROM per_label)"""
_PRF = sql.with_(_PREDICTIONS, _LABELS)


def _with_truth(messages):
    turn = F.col("msg_id") - F.col("conv_id") * 100
    pid = ((F.col("conv_id") * 31 + turn) % len(PROBLEMS)).cast("int")
    return messages.withColumn("truth", F.array(*[F.lit(t) for t in PHRASE_TRUTHS])[pid])


def _cells(spark, sf_dir):
    predictions = intent.classify(_with_truth(inputs.messages(spark, sf_dir)))
    return metrics.confusion(predictions, "truth", "intent")


@query(
    sql.with_(_PREDICTIONS)
    + "\nSELECT round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM predictions"
)
def k1_accuracy(spark, sf_dir):
    return metrics.accuracy(_cells(spark, sf_dir))


@query(sql.with_(_PREDICTIONS) + "\nSELECT truth, predicted, count(*) AS n FROM predictions GROUP BY ALL")
def k2_confusion(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(
    _PRF
    + """
SELECT round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall,
       round(avg(f), 4) AS macro_f1 FROM prf"""
)
def k2_macro_scores(spark, sf_dir):
    return metrics.macro_scores(_cells(spark, sf_dir))


@query(
    _PRF
    + """
SELECT round(sum(p * support) / sum(support), 4) AS weighted_precision,
       round(sum(r * support) / sum(support), 4) AS weighted_recall,
       round(sum(f * support) / sum(support), 4) AS weighted_f1 FROM prf"""
)
def k3_weighted_scores(spark, sf_dir):
    return metrics.weighted_scores(_cells(spark, sf_dir))


@query(
    _PRF
    + """
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM prf
UNION ALL
SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL
SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4),
       round(sum(f * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL
SELECT 'accuracy', a, a, a, n FROM (
  SELECT round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 4) AS a, count(*) AS n FROM predictions)"""
)
def k4_class_report(spark, sf_dir):
    return metrics.class_report(_cells(spark, sf_dir))


_ACTIONS = """actions_seen AS (
  SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS truth,
         CASE WHEN d.n_chars % 3 = 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS predicted
  FROM documents d JOIN labels l USING (doc_id)),
counts AS (
  SELECT count(*) FILTER (truth = 'ESCALATE' AND predicted = 'ESCALATE') AS tp,
         count(*) FILTER (truth <> 'ESCALATE' AND predicted = 'ESCALATE') AS fp,
         count(*) FILTER (truth = 'ESCALATE' AND predicted <> 'ESCALATE') AS fn,
         count(*) FILTER (truth <> 'ESCALATE' AND predicted <> 'ESCALATE') AS tn
  FROM actions_seen)"""


def _action_cells(spark, sf_dir):
    documents = inputs.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = documents.join(inputs.read(spark, sf_dir, "labels"), "doc_id").select(
        F.when(F.col("quality") == 1, "AUTO_HANDLE").otherwise("ESCALATE").alias("truth"),
        F.when(F.col("n_chars") % 3 == 0, "ESCALATE").otherwise("AUTO_HANDLE").alias("predicted"),
    )
    return metrics.confusion(rows, "truth", "predicted")


@query(
    sql.with_(_ACTIONS)
    + """
SELECT round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM counts"""
)
def k5_binary_scores(spark, sf_dir):
    return metrics.binary_scores(_action_cells(spark, sf_dir))


@query(
    sql.with_(_ACTIONS)
    + """
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives FROM counts"""
)
def k6_binary_counts(spark, sf_dir):
    return metrics.binary_counts(_action_cells(spark, sf_dir))


# --- K: reply scores -------------------------------------------------------------------------------------

def _marker_sum(text: str, markers) -> str:
    return " + ".join(f"CAST(contains({text}, {sql.lit(m)}) AS INTEGER)" for m in markers)


def _judge_sql(reply: str, has_evidence: str) -> str:
    return f"""3 AS judge_correctness, CASE WHEN {has_evidence} THEN 3 ELSE 2 END AS judge_groundedness,
       least(2 + {_marker_sum(f"lower({reply})", fixed.ACTION_MARKERS)}, 5) AS judge_helpfulness,
       least(3 + {_marker_sum(f"lower({reply})", fixed.EMPATHY_MARKERS)}, 5) AS judge_tone,
       greatest(5 - ({_marker_sum(f"lower({reply})", fixed.PROMISE_MARKERS)}), 2) AS judge_hallucination"""


# Past replies of the brand, judged as if every reply of several lines had evidence.
_PAST = MESSAGES + f""",
past AS (
  SELECT tweet_id, {_judge_sql("text", "contains(text, chr(10))")}
  FROM support_turns WHERE NOT inbound)"""


def _past_scores(spark, sf_dir):
    turns = inputs.support_turns(spark, sf_dir).where("NOT inbound")
    replies = turns.select(
        "tweet_id",
        F.col("text").alias("reply"),
        F.when(F.contains("text", F.lit("\n")), F.array(F.lit(1)))
        .otherwise(F.array().cast("array<int>"))
        .alias("evidence"),
    )
    return quality.heuristic_scores(replies).select("tweet_id", *quality.JUDGE_COLUMNS)


@query(sql.with_(_PAST) + "\nSELECT * FROM past")
def k7_heuristic_scores(spark, sf_dir):
    return _past_scores(spark, sf_dir)


JUDGED = sql.triage_ctes() + f""",
{sql.rows("truths", "pid, truth", list(enumerate(PHRASE_TRUTHS)))},
judged AS (
  SELECT CAST(r.msg_id AS VARCHAR) AS conversation_id, r.message, t.truth AS true_intent,
         r.intent AS pred_intent, x.default_action AS true_action, r.decision AS pred_action, r.reply,
         {_judge_sql("r.reply", "r.cases > 0")}
  FROM routed r JOIN truths t ON t.pid = (r.conv_id * 31 + r.msg_id - r.conv_id * 100) % {len(PROBLEMS)}
  JOIN taxonomy x ON x.intent = t.truth),
averaged AS (
  SELECT *, (judge_correctness + judge_groundedness + judge_helpfulness + judge_tone
             + judge_hallucination) / 5 AS avg_judge_score FROM judged)"""
_FAILED_COLUMNS = "conversation_id, true_intent, pred_intent, true_action, pred_action"


def results(spark, sf_dir, whole=False):
    """Triaged messages beside their truth, in the form of an evaluation run."""
    action = F.array(
        *[F.lit(SUPPORT_PACK.intent(name).default_action) for name in PHRASE_TRUTHS]
    )
    turn = F.col("msg_id") - F.col("conv_id") * 100
    pid = ((F.col("conv_id") * 31 + turn) % len(PROBLEMS)).cast("int")
    # Results print the queries of their cases.
    cases = inputs.triaged_with_cases(spark, sf_dir, ("initial_query",), whole)
    triaged = _with_truth(cases).select(
        F.col("msg_id").cast("string").alias("conversation_id"),
        F.col("truth").alias("true_intent"),
        action[pid].alias("true_action"),
        "*",
    )
    return quality.agent_results(triaged)


def _judged(spark, sf_dir, whole=False):
    return quality.heuristic_scores(results(spark, sf_dir, whole))


@query(sql.whole_texts(sql.with_(JUDGED) + "\nSELECT * FROM judged"))
def k8_judged_results(spark, sf_dir):
    return _judged(spark, sf_dir, whole=True).select(
        "conversation_id", "message", "true_intent", "pred_intent", "true_action", "pred_action",
        "reply", *quality.JUDGE_COLUMNS,
    )


@query(
    sql.with_(JUDGED)
    + "".join(
        f"""
{'UNION ALL ' if i else ''}SELECT '{name}' AS dimension, round(avg(judge_{name}), 3) AS mean FROM judged"""
        for i, name in enumerate(DIMENSIONS)
    )
)
def k9_mean_scores(spark, sf_dir):
    return quality.mean_scores(_judged(spark, sf_dir))


@query(
    sql.whole_texts(
        sql.with_(JUDGED)
        + f"""
SELECT j.conversation_id, j.message, j.true_intent, j.pred_intent, r.confidence, j.true_action,
       j.pred_action, r.reason AS escalation_reason, j.reply, r.grounding = 'supported' AS reply_grounded,
       r.grounding = 'supported' AS historical_grounded, r.answer_supported, r.support_reason,
       r.grounding_reason, r.generation_model,
       coalesce((SELECT CAST(to_json(list({{'query': left(e.initial_query, 100), 'score': e.similarity_score}}
                   ORDER BY e.rank)) AS VARCHAR) FROM evidence e WHERE e.msg_id = r.msg_id), '[]') AS evidence
FROM judged j JOIN routed r ON CAST(r.msg_id AS VARCHAR) = j.conversation_id"""
    )
)
def k10_agent_results(spark, sf_dir):
    return results(spark, sf_dir, whole=True)


@query(sql.with_(JUDGED) + f"\nSELECT {_FAILED_COLUMNS} FROM judged WHERE true_intent <> pred_intent")
def k11_intent_failures(spark, sf_dir):
    return quality.intent_failures(_judged(spark, sf_dir)).select(*_FAILED_COLUMNS.split(", "))


@query(sql.with_(JUDGED) + f"\nSELECT {_FAILED_COLUMNS} FROM judged WHERE true_action <> pred_action")
def k12_escalation_failures(spark, sf_dir):
    return quality.escalation_failures(_judged(spark, sf_dir)).select(*_FAILED_COLUMNS.split(", "))


@query(
    sql.with_(_PAST)
    + """
SELECT * FROM (SELECT tweet_id, round((judge_correctness + judge_groundedness + judge_helpfulness
    + judge_tone + judge_hallucination) / 5, 4) AS avg_judge_score FROM past)
WHERE avg_judge_score < 3.0"""
)
def k13_low_quality(spark, sf_dir):
    return quality.low_quality(_past_scores(spark, sf_dir), "tweet_id").select(
        "tweet_id", F.round("avg_judge_score", 4).alias("avg_judge_score")
    )


@query(
    sql.with_(JUDGED)
    + """
SELECT conversation_id, round(avg_judge_score, 4) AS avg_judge_score FROM averaged"""
)
def k13_mean_per_reply(spark, sf_dir):
    return quality.with_mean_score(_judged(spark, sf_dir)).select(
        "conversation_id", F.round("avg_judge_score", 4).alias("avg_judge_score")
    )


_ANY = "true_intent <> pred_intent OR true_action <> pred_action OR avg_judge_score < 3.0"


@query(sql.with_(JUDGED) + f"\nSELECT {_FAILED_COLUMNS} FROM averaged WHERE {_ANY}")
def k14_any_failure(spark, sf_dir):
    return quality.any_failure(_judged(spark, sf_dir)).select(*_FAILED_COLUMNS.split(", "))


@query(
    sql.with_(JUDGED)
    + f"""
SELECT count(*) FILTER (true_intent <> pred_intent) AS intent_failures,
       count(*) FILTER (true_action <> pred_action) AS escalation_failures,
       count(*) FILTER (avg_judge_score < 3.0) AS low_quality,
       count(*) FILTER ({_ANY}) AS any_failure FROM averaged"""
)
def k14_failure_counts(spark, sf_dir):
    return quality.failure_counts(_judged(spark, sf_dir))


def _weakly_labelled(spark, sf_dir):
    return intent.weak_label(_with_truth(inputs.messages(spark, sf_dir)), label="label")


_MAJORITY = f"""majority AS (
  SELECT coalesce(b.intent, 'other_general') AS label
  FROM messages m LEFT JOIN best b USING (msg_id) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


def _comparison_sql(model: str, predictions: str) -> str:
    """One row of intent metrics over a (truth, predicted) relation."""
    return f"""SELECT '{model}' AS model,
  (SELECT round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 4) FROM {predictions}) AS accuracy,
  round(avg(f), 4) AS macro_f1, round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall,
  round(sum(f * support) / sum(support), 4) AS weighted_f1
FROM (SELECT label, support, CASE WHEN claimed = 0 THEN 0.0 ELSE tp / claimed END AS p,
        CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r, 2 * tp / (claimed + support) AS f
      FROM (SELECT label, sum(CAST(truth = label AND predicted = label AS INTEGER)) AS tp,
              sum(CAST(predicted = label AS INTEGER)) AS claimed, sum(CAST(truth = label AS INTEGER)) AS support
            FROM {predictions}, (SELECT truth AS label FROM {predictions}
                                 UNION SELECT predicted FROM {predictions}) GROUP BY label))"""


_MAJORITY_PREDICTIONS = """majority_predictions AS (
  SELECT truth, (SELECT label FROM majority) AS predicted FROM predictions)"""


@query(
    sql.with_(_PREDICTIONS, _MAJORITY, _MAJORITY_PREDICTIONS)
    + "\n" + _comparison_sql("Majority Class", "majority_predictions")
)
def k15_majority_metrics(spark, sf_dir):
    rows = _weakly_labelled(spark, sf_dir)
    cells = metrics.confusion(baselines.predict_majority(rows, rows), "truth", "predicted")
    return metrics.model_comparison({plan.MAJORITY: cells})


_LINEAR = sql.recursive(
    sql.with_(
        _PREDICTIONS,
        """labelled AS (
  SELECT m.msg_id, coalesce(b.intent, 'other_general') AS label
  FROM messages m LEFT JOIN best b USING (msg_id))""",
        sql.tfidf("messages", "msg_id", "message", fixed.BASELINE_MAX_FEATURES),
        sql.linear_fit([x.name for x in SUPPORT_PACK.intents]),
        """linear_predictions AS MATERIALIZED (
  SELECT p.truth, l.predicted FROM predictions p JOIN linear l USING (msg_id))""",
    )
)


@query(_LINEAR + "\n" + _comparison_sql("TF-IDF + LogReg", "linear_predictions"))
def k15_linear_metrics(spark, sf_dir):
    rows = _weakly_labelled(spark, sf_dir)
    predicted = baselines.fit_text_classifier(rows).predict(rows)
    cells = metrics.confusion(
        rows.select("msg_id", "truth").join(predicted, "msg_id"), "truth", "predicted"
    )
    return metrics.model_comparison({plan.LINEAR: cells})


@query(
    sql.with_(_PREDICTIONS, _MAJORITY, _MAJORITY_PREDICTIONS)
    + "\n" + _comparison_sql("Majority Class", "majority_predictions")
    + "\nUNION ALL\n" + _comparison_sql("Agent", "predictions")
)
def k16_model_comparison(spark, sf_dir):
    rows = _weakly_labelled(spark, sf_dir)
    majority = metrics.confusion(baselines.predict_majority(rows, rows), "truth", "predicted")
    return metrics.model_comparison(
        {plan.MAJORITY: majority, plan.AGENT: _cells(spark, sf_dir)}
    )


def _means(name: str) -> str:
    return f"SELECT 'reply_quality.{name}.mean' AS path, round(avg(judge_{name}), 3) AS value FROM judged"


def _beside(ctes: str) -> str:
    """The CTEs of a vocabulary under other names, for use beside those of the index."""
    return ctes.replace("doc_", "own_").replace("vocab", "own_vocab")


_K17_MODELS = {
    plan.MAJORITY: "majority_predictions", plan.LINEAR: "linear_predictions",
    plan.AGENT: "agent_predictions",
}
_K17_ACTIONS = """action_counts AS (
  SELECT count(*) FILTER (true_action = 'ESCALATE' AND pred_action = 'ESCALATE') AS true_positives,
         count(*) FILTER (true_action <> 'ESCALATE' AND pred_action = 'ESCALATE') AS false_positives,
         count(*) FILTER (true_action = 'ESCALATE' AND pred_action <> 'ESCALATE') AS false_negatives,
         count(*) FILTER (true_action <> 'ESCALATE' AND pred_action <> 'ESCALATE') AS true_negatives
  FROM judged),
action_scores AS (
  SELECT *, CASE WHEN true_positives + false_positives = 0 THEN 0 ELSE
              round(true_positives / (true_positives + false_positives), 4) END AS precision,
         CASE WHEN true_positives + false_negatives = 0 THEN 0 ELSE
              round(true_positives / (true_positives + false_negatives), 4) END AS recall,
         CASE WHEN 2 * true_positives + false_positives + false_negatives = 0 THEN 0 ELSE round(
              2 * true_positives / (2 * true_positives + false_positives + false_negatives), 4) END AS f1
  FROM action_counts)"""


@query(
    sql.recursive(
        sql.with_(
            JUDGED,
            "agent_predictions AS (SELECT true_intent AS truth, pred_intent AS predicted FROM judged)",
            """labelled AS (
  SELECT m.msg_id, coalesce(b.intent, 'other_general') AS label
  FROM messages m LEFT JOIN best b USING (msg_id))""",
            "majority AS (SELECT label FROM labelled GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
            """majority_predictions AS (
  SELECT truth, (SELECT label FROM majority) AS predicted FROM agent_predictions)""",
            _beside(sql.tfidf("messages", "msg_id", "message", fixed.BASELINE_MAX_FEATURES)),
            _beside(sql.linear_fit([x.name for x in SUPPORT_PACK.intents])),
            """linear_predictions AS MATERIALIZED (
  SELECT j.true_intent AS truth, l.predicted
  FROM judged j JOIN linear l ON CAST(l.msg_id AS VARCHAR) = j.conversation_id)""",
            _K17_ACTIONS,
            "compared AS ("
            + "\nUNION ALL\n".join(_comparison_sql(m, rows) for m, rows in _K17_MODELS.items())
            + ")",
        )
    )
    + """
SELECT concat('models.', model, '.', metric) AS path, value FROM (
  UNPIVOT (SELECT model, accuracy::DOUBLE AS accuracy, macro_f1::DOUBLE AS macro_f1,
                  macro_precision::DOUBLE AS macro_precision, macro_recall::DOUBLE AS macro_recall,
                  weighted_f1::DOUBLE AS weighted_f1 FROM compared)
  ON accuracy, macro_f1, macro_precision, macro_recall, weighted_f1
  INTO NAME metric VALUE value)
UNION ALL
SELECT concat('escalation.', metric), value FROM (
  UNPIVOT (SELECT precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1,
                  true_positives::DOUBLE AS true_positives, false_positives::DOUBLE AS false_positives,
                  false_negatives::DOUBLE AS false_negatives, true_negatives::DOUBLE AS true_negatives
           FROM action_scores)
  ON precision, recall, f1, true_positives, false_positives, false_negatives, true_negatives
  INTO NAME metric VALUE value)
UNION ALL
"""
    + "\nUNION ALL\n".join(_means(name) for name in DIMENSIONS)
)
def k17_summary(spark, sf_dir):
    """The summary of an evaluation, written as a nested document and read back as rows."""
    judged = cut_lineage(_judged(spark, sf_dir))
    rows = cut_lineage(_weakly_labelled(spark, sf_dir).select("msg_id", "message", "truth", "label"))
    linear = baselines.fit_text_classifier(rows).predict(rows)
    cells = {
        plan.MAJORITY: metrics.confusion(baselines.predict_majority(rows, rows), "truth", "predicted"),
        plan.LINEAR: metrics.confusion(rows.join(linear, "msg_id"), "truth", "predicted"),
        plan.AGENT: metrics.confusion(judged, "true_intent", "pred_intent"),
    }
    run = plan.evaluation_of(judged, cells)
    folder = f"{shared_folder(spark)}/threadwise-summary-{uuid.uuid4().hex}"
    tables.write_nested(run.summary(), folder)
    return plan.summary_rows(spark.read.json(folder))


# --- L: agreement ------------------------------------------------------------------------------------------

# Human and judge scores for all five dimensions, derived from every labelled document; "tone"
# never varies. "unchecked" is a rating that is out of range for some documents.
_HUMAN = {
    "correctness": "1 + 2 * quality",
    "groundedness": "1 + (n_chars + quality) % 5",
    "helpfulness": "2 + 3 * quality - toxic",
    "tone": "4",
    "hallucination": "5 - 3 * toxic",
}
_JUDGE = {
    "correctness": "1 + n_chars % 5",
    "groundedness": "1 + (n_chars + 2 * quality) % 5",
    "helpfulness": "1 + (n_chars + doc_id) % 5",
    "tone": "3 + doc_id % 3",
    "hallucination": "5 - doc_id % 5",
}
_RATED_DIMENSIONS = tuple(_HUMAN)
_RATINGS = [
    *[f"cast({value} AS int) AS {name}" for name, value in _HUMAN.items()],
    *[f"cast({value} AS int) AS judge_{name}" for name, value in _JUDGE.items()],
    "cast(1 + 4 * quality - toxic AS int) AS unchecked",
]
_RATED = f"""rated AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS conversation_id, {", ".join(_RATINGS)}
  FROM documents JOIN labels USING (doc_id))"""
_SCORES = _RATED + """,
scores AS (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {name} AS human, judge_{name} AS judge FROM rated"
    for name in _RATED_DIMENSIONS
) + ")"


def _rated(spark, sf_dir):
    documents = inputs.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return documents.join(inputs.read(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "doc_id", "cast(doc_id AS string) AS conversation_id", *_RATINGS
    )


def _scores(spark, sf_dir):
    return agreement.long_scores(_rated(spark, sf_dir), _RATED_DIMENSIONS)


@query(
    """SELECT text AS conversation_id, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1"""
)
def l3_repeated_ids(spark, sf_dir):
    """Documents stand in for ratings; their exact copies are the repeated ids."""
    rated = inputs.read(spark, sf_dir, "documents").select(F.col("text").alias("conversation_id"))
    return agreement.repeated_ids(rated)


@query(
    sql.with_(_RATED)
    + """
SELECT 'unchecked' AS dimension, count(*) AS invalid FROM rated
WHERE unchecked NOT BETWEEN 1 AND 5 HAVING count(*) > 0"""
)
def l4_invalid_dimensions(spark, sf_dir):
    return agreement.invalid_dimensions(_rated(spark, sf_dir), (*_RATED_DIMENSIONS, "unchecked"))


@query(
    """
SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def l5_unknown_ids(spark, sf_dir):
    documents = inputs.read(spark, sf_dir, "documents").select("doc_id")
    return agreement.unknown_ids(documents, inputs.read(spark, sf_dir, "labels"), "doc_id")


@query(
    """
SELECT d.doc_id, d.n_chars AS n_chars_judge, l.quality, l.toxic, l.quality + 1 AS n_chars_human
FROM documents d JOIN labels l USING (doc_id)"""
)
def l6_join_ratings(spark, sf_dir):
    documents = inputs.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = inputs.read(spark, sf_dir, "labels").withColumn("n_chars", F.col("quality") + 1)
    return agreement.join_ratings(documents, labels, "doc_id")


@query(
    sql.with_(_SCORES)
    + """
SELECT dimension, CAST(human AS DOUBLE) AS human, CAST(judge AS DOUBLE) AS judge, count(*) AS n
FROM scores GROUP BY ALL"""
)
def l7_score_cells(spark, sf_dir):
    return agreement.score_cells(_scores(spark, sf_dir))


def _agreement_query(name: str, column: str, expression: str, source: str = "scores") -> None:
    def run(spark, sf_dir):
        return agreement.agreement(_scores(spark, sf_dir)).select("dimension", column)

    run.__name__ = name
    query(
        sql.with_(_SCORES)
        + f"\nSELECT dimension, {expression} AS {column} FROM {source} GROUP BY dimension"
    )(run)


def _guarded(x: str, y: str) -> str:
    return (
        f"round(CASE WHEN stddev_pop({x}) < 1e-9 OR stddev_pop({y}) < 1e-9 THEN 0.0 "
        f"ELSE corr({x}, {y}) END, 4)"
    )


_RANKED = """(SELECT dimension,
  rank() OVER (PARTITION BY dimension ORDER BY human)
    + (count(*) OVER (PARTITION BY dimension, human) - 1) / 2 AS hr,
  rank() OVER (PARTITION BY dimension ORDER BY judge)
    + (count(*) OVER (PARTITION BY dimension, judge) - 1) / 2 AS jr FROM scores)"""
_agreement_query(
    "l8_percentage_agreement", "percentage_agreement",
    "round(100 * avg(CASE WHEN abs(human - judge) <= 1 THEN 1.0 ELSE 0.0 END), 2)",
)
_agreement_query("l9_mean_abs_error", "mean_abs_error", "round(avg(abs(human - judge)), 4)")
_agreement_query("l10_pearson", "pearson_r", _guarded("human", "judge"))
_agreement_query("l11_spearman", "spearman_r", _guarded("hr", "jr"), _RANKED)
_agreement_query("l12_samples", "n_samples", "count(*)")


@query(
    sql.whole_texts(
        sql.with_(JUDGED)
        + """
SELECT conversation_id, message, reply, '' AS correctness, '' AS groundedness, '' AS helpfulness,
       '' AS tone, '' AS hallucination FROM judged ORDER BY conversation_id LIMIT 50"""
    )
)
def l13_rating_template(spark, sf_dir):
    return agreement.rating_template(_judged(spark, sf_dir, whole=True))


# --- A, L: tables with defects, reported whole ----------------------------------------------------------

@query(_LABELLED + "\nSELECT * FROM golden")
def a3_golden_read_back(spark, sf_dir):
    """An evaluation set written as CSV and scanned again."""
    folder = f"{shared_folder(spark)}/threadwise-golden-{uuid.uuid4().hex}"
    tables.write_flat(_golden(spark, sf_dir), folder, "csv")
    return tables.read_golden(spark, folder).withColumn(
        "conversation_id", F.col("conversation_id").cast("long")
    )


# Ratings of all labelled documents without their tone; every seventh is rated twice, every ninth
# unknown to the results, some scores are fractions, blanks or out of range.
_FAULTY_SCORES = {
    "correctness": "CASE WHEN doc_id % 5 = 0 THEN '3.5' ELSE '4' END",
    "groundedness": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE '2' END",
    "helpfulness": "CASE WHEN toxic = 1 THEN '6' ELSE '5.0' END",
    "hallucination": "'1'",
}
_FAULTY = f"""faulty AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, {", ".join(f"{v} AS {k}" for k, v in _FAULTY_SCORES.items())}
  FROM labels JOIN (SELECT 1 AS copy UNION ALL SELECT 2) ON copy = 1 OR doc_id % 7 = 0)"""
_GOOD_SCORE = "coalesce(TRY_CAST({0} AS DOUBLE) BETWEEN 1 AND 5 AND TRY_CAST({0} AS DOUBLE) % 1 = 0, FALSE)"


@query(
    sql.with_(_FAULTY)
    + """
SELECT 'missing_column' AS check, 'tone' AS subject, CAST(0 AS BIGINT) AS rows
UNION ALL
SELECT 'repeated_id', id, count(*) FROM faulty GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT DISTINCT 'unknown_id', id, CAST(1 AS BIGINT) FROM faulty WHERE CAST(id AS BIGINT) % 9 = 0
"""
    + "".join(
        f"""UNION ALL
SELECT 'invalid_score', '{name}', count(*) FROM faulty WHERE NOT {_GOOD_SCORE.format(name)}
HAVING count(*) > 0
"""
        for name in _FAULTY_SCORES
    )
)
def l2_rating_violations(spark, sf_dir):
    """Everything that is wrong with a file of ratings, read as it was written."""
    labels = inputs.read(spark, sf_dir, "labels")
    copies = F.explode(F.expr("IF(doc_id % 7 = 0, array(1, 2), array(1))"))
    ratings = labels.select("*", copies.alias("copy")).selectExpr(
        "cast(doc_id AS string) AS conversation_id", "'m' AS message", "'r' AS reply",
        *[f"{value} AS {name}" for name, value in _FAULTY_SCORES.items()],
    )
    folder = f"{shared_folder(spark)}/threadwise-ratings-{uuid.uuid4().hex}"
    tables.write_flat(ratings, folder, "csv")
    results = labels.where("doc_id % 9 <> 0").selectExpr("cast(doc_id AS string) AS conversation_id")
    return agreement.rating_violations(
        tables.read_ratings(spark, folder),
        results,
        tables.absent_columns(spark, folder, schemas.HUMAN_RATINGS),
    )


@query(
    sql.with_(_RATED)
    + "\nSELECT conversation_id, "
    + ", ".join(f"CAST({name} AS VARCHAR) AS {name}" for name in DIMENSIONS)
    + ", judge_tone FROM rated"
)
def a4_ratings_read_back(spark, sf_dir):
    """Ratings and judged results written as CSV, scanned again and joined."""
    folder = f"{shared_folder(spark)}/threadwise-rated-{uuid.uuid4().hex}"
    rows = _rated(spark, sf_dir)
    tables.write_flat(
        rows.select("conversation_id", *[F.col(name).cast("string") for name in DIMENSIONS]),
        f"{folder}/ratings", "csv",
    )
    tables.write_flat(
        rows.select("conversation_id", *[f"judge_{name}" for name in DIMENSIONS]),
        f"{folder}/results", "csv",
    )
    ratings = tables.read_ratings(spark, f"{folder}/ratings").select("conversation_id", *DIMENSIONS)
    judged = tables.read_judged(spark, f"{folder}/results").select("conversation_id", "judge_tone")
    return ratings.join(judged, "conversation_id")


# --- S: streaming -------------------------------------------------------------------------------------------

@query(
    sql.with_(sql.triage_ctes(3))
    + "\nSELECT msg_id, intent, cases, reply_rule, decision, rule FROM routed"
)
def s1_stream_triage(spark, sf_dir):
    """Messages arrive as files, one batch each; the result must equal batch triage."""
    folder = f"{shared_folder(spark)}/threadwise-stream-{uuid.uuid4().hex}"
    messages = inputs.messages(spark, sf_dir).select("msg_id", "message")
    messages.write.parquet(f"{folder}/arriving")
    stream = read_messages(spark, f"{folder}/arriving")
    start_triage(
        stream, inputs.support_index(spark, sf_dir), f"{folder}/triaged", f"{folder}/progress",
        available_now=True,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/triaged").select(
        "msg_id", "intent", F.size("evidence").cast("long").alias("cases"), "reply_rule",
        "escalation.decision", "escalation.rule",
    )

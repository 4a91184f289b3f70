"""Intent, reply, grounding and routing rules on messages of our own wording."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from threadwise.functions.text import term_set
from threadwise.operators import intent, quality, replies, routing
from threadwise.operators.intent import LOWERED, with_lowered
from threadwise.operators.tfidf import build_index
from threadwise.plans.triage import triage, triage_message
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK, Intent


def messages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "msg_id long, message string")


def classified(spark, *texts):
    rows = intent.classify(messages(spark, *texts)).orderBy("msg_id").collect()
    return rows if len(texts) > 1 else rows[0]


def test_taxonomy(spark):
    rows = intent.taxonomy(spark).orderBy("ord").collect()
    assert [r.intent for r in rows] == SUPPORT_PACK.intent_names and len(rows) == 11
    escalating = {r.intent for r in rows if r.default_action == "ESCALATE"}
    assert escalating == set(fixed.SENSITIVE_INTENTS)


def test_primary_is_first_of_list(spark):
    row = classified(spark, "The battery is draining")
    assert (row.intent, row.intents) == ("device_hardware_issue", ["device_hardware_issue"])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The ATM refused my debit card", "card_atm_issue"),
        ("I want to recover my Apple account", "account_appleid_issue"),
        ("Phone storage is full", "device_storage_issue"),
        ("My phone is so hot", "device_hardware_issue"),
        ("It keeps restarting on its own", "device_hardware_issue"),
        ("How do I make a screenshot?", "device_how_to"),
        ("I don't recognize the charge from Apple", "payment_billing_issue"),
        ("nothing of note", "other_general"),
    ],
)
def test_intents(spark, text, expected):
    assert classified(spark, text).intent == expected


def test_two_issues(spark):
    row = classified(spark, "The screen broke, then I was charged twice")
    assert row.intents == ["device_hardware_issue", "payment_billing_issue"]


def test_confidence_by_hits(spark):
    texts = ["battery", "battery screen", "battery screen heat", "battery screen heat hot",
             "battery screen heat hot mic", "battery screen heat hot mic camera", "", None]
    rows = classified(spark, *texts)
    assert [r.confidence for r in rows] == [0.63, 0.71, 0.79, 0.87, 0.88, 0.88, 0.3, 0.3]
    assert rows[2].reasoning == wording.HIT_REASONING % 3


def test_repeats_count_once_and_overlaps_all_count(spark):
    assert classified(spark, "battery battery").confidence == 0.63
    hits = {r.intent: r.hits for r in intent.hit_table(messages(spark, "storage is full")).collect()}
    assert hits["device_storage_issue"] == 3


def test_ties_follow_taxonomy_order(spark):
    row = classified(spark, "in the store")
    assert row.intents == ["app_store_issue", "order_shipping_issue"]


def test_overrides(spark):
    how, charge = classified(
        spark, "How can I delete an app and charge it", "an unauthorized payment from the store"
    )
    assert (how.intent, how.intents, how.confidence) == ("device_how_to", ["device_how_to"], 0.88)
    assert (charge.intent, charge.confidence) == ("payment_billing_issue", 0.88)
    assert how.override == "how_to_request" and not how.needs_model


def test_curly_apostrophe_does_not_match(spark):
    assert classified(spark, "i don’t recognize this charge").override is None


def test_needs_model(spark):
    settled, open_ = classified(spark, "the phone is hot", "the battery drains")
    assert not settled.needs_model and open_.needs_model


def test_weak_label_ignores_overrides(spark):
    df = messages(spark, "how can i remove it, the battery and screen", "nothing")
    labels = [r.weak_label for r in intent.weak_label(df).orderBy("msg_id").collect()]
    assert labels == ["device_hardware_issue", "other_general"]


def test_filters_on_results_do_not_repeat_the_rules(spark):
    plan = intent.classify(messages(spark, "x")).where("needs_model")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 0 and text.count("won't turn on") <= 2


def test_display_labels(spark):
    df = intent.display_label(
        spark.createDataFrame(
            [("payment_billing_issue", "Charged twice!"), ("payment_billing_issue", "a refund"),
             ("odd", "x")],
            "intent string, message string",
        )
    )
    assert [r.display_label for r in df.collect()] == [
        fixed.DUPLICATE_CHARGE_LABEL, "Billing and Purchases", "odd",
    ]


# --- replies ---------------------------------------------------------------------------------------

def known(spark, text, name):
    df = with_lowered(spark.createDataFrame([(text, name)], "message string, intent string"), "message")
    return df.select(replies.known_rule(F.col(LOWERED), F.col("intent"))).first()[0]


@pytest.mark.parametrize(
    "text, name, rule",
    [
        ("anything", "device_storage_issue", "storage_intent"),
        ("low storage", "card_atm_issue", "storage_text"),
        ("screen shot", "device_how_to", "screen_capture"),
        ("how to delete a app", "device_how_to", "remove_app"),
        ("record my screen", "device_how_to", "record_screen"),
        ("turn on the wi-fi", "device_how_to", "connect_wifi"),
        ("wifi please, how to connect", "device_how_to", "connect_wifi"),
        ("dark mode", "device_how_to", "dark_theme"),
        ("update my phone", "device_how_to", "update_system"),
        ("i forgot the passcode", "account_appleid_issue", "recover_password"),
        ("i must reset it", "account_appleid_issue", "recover_account"),
        ("it was compromised", "account_appleid_issue", "account_compromised"),
        ("boot loop", "other_general", "boot_loop"),
        ("wont turn on since ios 11", "device_hardware_issue", "dead_after_update"),
        ("the glass is cracked", "device_hardware_issue", "physical_damage"),
        ("no power", "device_hardware_issue", "no_power"),
        ("it doesn't charge", "other_general", "no_charge"),
        ("so hot", "device_hardware_issue", "overheating"),
        ("it reboots", "software_update_issue", "restarting"),
        ("paid twice", "payment_billing_issue", "double_charge"),
        ("unknown entry", "payment_billing_issue", "unrecognised_charge"),
        ("please stop it", "subscription_services", "cancel_subscription"),
        ("an error", "app_store_issue", "store_download"),
        ("so hot", "app_store_issue", None),
    ],
)
def test_known_rules(spark, text, name, rule):
    assert known(spark, text, name) == rule


def test_replies_hold_the_steps():
    text = {r.name: r.reply for r in SUPPORT_PACK.reply_rules}
    for rule, words in {
        "remove_app": ("Remove App", "Delete App"), "connect_wifi": ("Settings",),
        "record_screen": ("Control Center",), "dark_theme": ("Display & Brightness",),
        "update_system": ("Software Update",),
        "recover_password": ("Sign-In & Security", "iforgot.apple.com"),
        "unrecognised_charge": ("do not recognize",),
    }.items():
        assert all(word in text[rule] for word in words)
    assert "duplicate" not in text["unrecognised_charge"].lower()


# Reply -> (action groups, empathy markers, action markers): these decide grounding and scores.
PROFILES = {
    "storage_intent": ("settings", 0, 1), "screen_capture": ("", 0, 0), "remove_app": ("", 0, 0),
    "record_screen": ("", 0, 0), "connect_wifi": ("account settings", 0, 1),
    "dark_theme": ("settings", 0, 1), "update_system": ("charge download settings", 0, 2),
    "recover_password": ("account contact_support settings", 0, 1),
    "recover_account": ("account contact_support", 1, 0),
    "account_compromised": ("account contact_support", 1, 0),
    "boot_loop": ("contact_support request_details", 1, 0),
    "dead_after_update": ("contact_support request_details", 1, 1),
    "physical_damage": ("contact_support", 1, 0),
    "no_power": ("charge contact_support request_details", 1, 0),
    "no_charge": ("charge charging_accessory contact_support", 0, 0),
    "overheating": ("contact_support", 0, 0),
    "restarting": ("contact_support download restart", 1, 3),
    "double_charge": ("account charge contact_support purchase", 1, 0),
    "unrecognised_charge": ("charge contact_support purchase request_details", 1, 0),
    "cancel_subscription": ("contact_support subscription", 0, 0),
    "store_download": ("contact_support download request_details", 1, 0),
    "t:device_how_to": ("", 0, 0),
    "t:software_update_issue": ("contact_support restart", 1, 3),
    "t:account_appleid_issue": ("account contact_support", 1, 0),
    "t:payment_billing_issue": ("charge contact_support purchase request_details", 1, 1),
    "t:card_atm_issue": ("contact_support purchase request_details", 1, 1),
    "t:subscription_services": ("account contact_support settings subscription", 1, 1),
    "t:app_store_issue": ("contact_support download restart", 1, 1),
    "t:order_shipping_issue": ("contact_support request_details", 1, 1),
    "t:other_general": ("contact_support request_details", 1, 0),
}


def test_reply_profiles(spark):
    texts = {r.name: r.reply for r in SUPPORT_PACK.reply_rules}
    texts |= {f"t:{i.name}": i.template for i in SUPPORT_PACK.intents}
    df = spark.createDataFrame([(k, texts[k]) for k in PROFILES], "name string, reply string")
    lowered = F.lower("reply")
    rows = df.select(
        "name",
        F.array_join(F.sort_array(replies.reply_actions(term_set(F.col("reply")))), " ").alias("a"),
        quality.marker_hits(lowered, fixed.EMPATHY_MARKERS).alias("e"),
        quality.marker_hits(lowered, fixed.ACTION_MARKERS).alias("m"),
    ).collect()
    assert {r.name: (r.a, r.e, r.m) for r in rows} == PROFILES


def test_damage_template_and_unknown_intent(spark):
    df = spark.createDataFrame(
        [("cracked", "device_hardware_issue"), ("cracked", "odd"), ("x", "card_atm_issue")],
        "message string, intent string",
    )
    rule = replies.template_rule(F.col(LOWERED), F.col("intent"))
    assert [r[0] for r in with_lowered(df, "message").select(rule).collect()] == [
        "damage", "other_general", "card_atm_issue",
    ]


CASE = "array<struct<initial_query: string, first_support_reply: string>>"


@pytest.mark.parametrize(
    "reply, cases, code",
    [
        ("Restart it", [], "no_evidence"),
        ("Please contact support so we can help", [("issue", "contact support")], "no_action"),
        ("Restart and open settings", [("app trouble", "contact support")], "unsupported_action"),
        ("Restart and open settings", [("it hangs", "restart"), ("?", "open settings")], "supported"),
    ],
)
def test_grounding(spark, reply, cases, code):
    df = spark.createDataFrame([(reply, cases)], f"reply string, evidence {CASE}")
    row = replies.ground_replies(df).first()
    assert row.grounding == code and row.grounded == (code == "supported")


# --- routing -----------------------------------------------------------------------------------------

def routed(spark, text, name, confidence=0.9, scores=(0.5,), intents=None, grounded=True,
           supported=True, reason="", policy=routing.RoutingPolicy()):
    schema = (
        "message string, intent string, intents array<string>, confidence double, "
        "evidence array<struct<similarity_score: double>>, best_similarity double, "
        "reply_grounded boolean, answer_supported boolean, grounding_reason string"
    )
    row = (text, name, intents or [name], confidence, [(s,) for s in scores],
           max(scores, default=0.0), grounded, supported, reason)
    return routing.route(spark.createDataFrame([row], schema), policy=policy).first().escalation


HW, SW, HOW = "device_hardware_issue", "software_update_issue", "device_how_to"
ACCOUNT, BILLING, ORDER = "account_appleid_issue", "payment_billing_issue", "order_shipping_issue"


@pytest.mark.parametrize(
    "text, name, options, rule",
    [
        ("reset my password", ACCOUNT, {}, "sensitive_account"),
        ("change the payment method", BILLING, {}, "sensitive_billing"),
        ("i paid twice", BILLING, {}, "sensitive_duplicate"),
        ("i was charged twice", BILLING, {}, "risk_duplicate"),
        ("unauthorized use", BILLING, {}, "risk_unrecognised"),
        ("hacked! changed my password", ACCOUNT, {}, "risk_compromised"),
        ("that is fraud", HW, {}, "risk_generic"),
        ("stolen parcel, tracking stopped", ORDER, {}, "other"),
        ("stolen parcel", ORDER, {}, "risk_generic"),
        ("stolen, tracking stopped", HW, {}, "risk_generic"),
        ("black screen after the update", SW, {}, "dead_device"),
        ("black screen after the update", "app_store_issue", {}, "standard"),
        ("black screen", HW, {}, "standard"),
        ("hm", "other_general", {"confidence": 0.3}, "low_confidence"),
        ("hm", "other_general", {"confidence": 0.6}, "other"),
        ("hm", HW, {"scores": ()}, "no_evidence"),
        ("hm", HOW, {"scores": ()}, "how_to_no_evidence"),
        ("hm", HOW, {"scores": (), "supported": False}, "no_evidence"),
        ("hm", HW, {"scores": (0.3499,)}, "weak_evidence"),
        ("hm", HW, {"scores": (0.35, 0.1)}, "standard"),
        ("hm", HOW, {"scores": (0.1,)}, "how_to_weak_evidence"),
        ("hm", HW, {"supported": False}, "unsupported_answer"),
        ("hm", HW, {"grounded": False}, "ungrounded"),
        ("hm", HOW, {"grounded": False, "scores": (0.8,)}, "standard"),
        ("hm", HW, {"intents": [HW, BILLING]}, "standard"),
        ("hm", BILLING, {"intents": [ACCOUNT, BILLING]}, "other"),
    ],
)
def test_routing(spark, text, name, options, rule):
    result = routed(spark, text, name, **options)
    assert result.rule == rule
    assert result.decision == ("AUTO_HANDLE" if rule in routing.AUTO_RULES else "ESCALATE")
    assert result.reason


def test_routing_reasons_and_thresholds(spark):
    assert routed(spark, "hm", HW, grounded=False, reason="why").reason == "why"
    assert routed(spark, "hm", ORDER).reason == wording.ROUTING_REASONS["other"] % ORDER
    loose = routing.RoutingPolicy(0.2, 0.05, require_grounding=False)
    assert routed(spark, "hm", HW, 0.3, (0.1,), grounded=False, policy=loose).rule == "standard"


def test_first_risk_pattern_and_gap(spark):
    df = with_lowered(messages(spark, "police and fraud", "refund was not yet received",
                               "refund " + "x" * 30 + " not received", "ok"), "message")
    found = [r[0] for r in df.select(routing.risk_pattern(F.col(LOWERED))).collect()]
    assert found[0] == r"\bfraud\b" and found[1].startswith(r"\brefund") and found[2:] == [None, None]


# --- the whole chain ------------------------------------------------------------------------------------

# Rule that decides -> a message it decides, when the corpus holds the message itself.
BY_RULE = {
    "risk_generic": "my lawyer is preparing a lawsuit over this tablet",
    "risk_compromised": "i think my login was hacked over night",
    "risk_unrecognised": "there is an unauthorized entry from a shop abroad",
    "dead_device": "black screen ever since the ios release came in",
    "sensitive_account": "the verification code never arrives, so i cannot sign in",
    "sensitive_duplicate": "my bank shows the same invoice twice",
    "sensitive_billing": "which bank handles the refund of my receipt",
    "low_confidence": "good morning to everybody over there",
    "unsupported_answer": "my game has been so slow and it does freeze a lot",
    "standard": "how do i take a screenshot on this thing",
}


def test_one_message_for_each_rule(spark):
    texts = list(BY_RULE.values())
    corpus = spark.createDataFrame(
        [(f"c{i}", t, "please restart, check settings and contact support") for i, t in enumerate(texts)],
        "conversation_id string, initial_query string, first_support_reply string",
    )
    index = build_index(corpus)
    rows = triage(messages(spark, *texts), index, k=3).orderBy("msg_id").collect()
    assert {r.message: r.escalation.rule for r in rows} == {t: rule for rule, t in BY_RULE.items()}
    assert all(1 <= len(r.evidence) <= 3 and r.best_similarity == 1.0 for r in rows)
    with pytest.raises(ValueError):
        triage(messages(spark, "x"), index, k=0)
    alone = triage_message(texts[-1], index, k=3).first()
    assert alone.escalation == rows[-1].escalation and alone.reply == rows[-1].reply


def test_message_without_a_known_term(spark):
    corpus = spark.createDataFrame(
        [("c0", "the speaker crackles", "restart it")],
        "conversation_id string, initial_query string, first_support_reply string",
    )
    row = triage(messages(spark, "arcade membership"), build_index(corpus)).first()
    assert (row.evidence, row.best_similarity, row.escalation.rule) == ([], 0.0, "no_evidence")
    assert row.grounding_reason == wording.GROUNDING_REASONS["no_evidence"]


def test_own_pack(spark):
    pack = replace(
        SUPPORT_PACK,
        intents=(Intent("tea", "AUTO_HANDLE", ("green tea", "kettle")), Intent("rest", "ESCALATE", ())),
        fallback_intent="rest", overrides=(), settled=(), reply_rules=(), risk_patterns=(),
    )
    rows = intent.classify(messages(spark, "Green tea, no kettle", "coffee"), pack=pack)
    assert [(r.intent, r.confidence) for r in rows.orderBy("msg_id").collect()] == [
        ("tea", 0.71), ("rest", 0.3),
    ]

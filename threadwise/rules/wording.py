"""Prose shown to customers, agents and models. Reword freely; keep the keys."""

INTENT_DESCRIPTIONS = {
    "device_hardware_issue": "Something physical is wrong: battery, screen, sound, camera, heat, power or charging.",
    "software_update_issue": "Trouble that comes with a system release: slowness, freezes, crashes, failed updates.",
    "device_storage_issue": "The device is out of space or warns that it soon will be.",
    "device_how_to": "The customer wants to know how to use a feature of a working device.",
    "account_appleid_issue": "Sign-in, password, verification, synchronisation or a taken-over account.",
    "payment_billing_issue": "Charges, refunds, invoices and payment methods on the customer's account.",
    "card_atm_issue": "A bank card is refused, or a cash machine gives trouble.",
    "subscription_services": "Starting, renewing, cancelling or trying out a paid service.",
    "app_store_issue": "Getting, installing or running an app from the store.",
    "order_shipping_issue": "Orders, deliveries, tracking, trade-ins and collection in a shop.",
    "other_general": "Anything else, greetings and general feedback included.",
}

KNOWN_REPLIES = {
    "storage_intent": "Large videos, unused games and old messages take most of the room.\nSettings > General > Storage lists them by size, so you can clear the biggest first.",
    "storage_text": "Large videos, unused games and old messages take most of the room.\nSettings > General > Storage lists them by size, so you can clear the biggest first.",
    "screen_capture": "Two buttons pressed at the same moment capture what you see.\nWhich two depends on the phone: side and volume up where it unlocks by face, side and home where there is a home key. The image waits in Photos.",
    "remove_app": "Keep pressing the icon until a list opens, then choose Remove App and Delete App.\nOnly that frees its space; without an icon on the Home Screen it still lies in the library.",
    "record_screen": "The round button in Control Center films what happens on the glass.\nAdd it there once, tap it to begin and tap the red sign when you are through. The film lies in Photos.",
    "connect_wifi": "Wireless networks are listed in Settings under Wi-Fi once the switch there is green.\nTap yours; the first time you will need its password, which is often printed on the router.",
    "dark_theme": "The dark look is one of two pictures in Settings > Display & Brightness.\nWith Automatic the phone follows sunset and sunrise.",
    "update_system": "A new release takes a while, so let the phone rest on its charger within reach of Wi-Fi.\nSettings > General > Software Update offers it; pick Download and Install.",
    "recover_password": "The quickest way is a device on which you are still signed in: Settings, your name, Sign-In & Security, Change Password.\nIf there is none, iforgot.apple.com begins the recovery, and our support can assist on the way.",
    "recover_account": "We appreciate how much hangs on this.\nThe wait built into recovery can take days and nobody can shorten it, so begin it before anything else and keep one old phone signed in meanwhile. Support can tell you the day it ends.",
    "account_compromised": "That is alarming, and we are sorry.\nA stranger using your account is a case for our security people: contact them through support, and start the recovery now to lock the stranger out.",
    "boot_loop": "A start that never ends is no fun, sorry.\nTell support which model you hold and which version it ran, and they will take it from there.",
    "dead_after_update": "Sorry, a dark display straight after an update should not be.\nTell support the model, the version and what happened right before.",
    "physical_damage": "A repair is priced before any work begins, and a plan that covers accidents lowers the price.\nWe understand the worry about the pictures on it: save a copy of them, then book a bench visit through support.",
    "no_power": "Sorry, that sounds frustrating.\nLet support know the model and whether anything shows while it is on power.",
    "no_charge": "Often the cable is worn or there is dust in the port.\nSwap the cable, clean the port and use another charger; support can look at the battery if nothing changes.",
    "overheating": "Take the phone out of its case and into the shade, and let it rest.\nA phone that is hot without any work to do is one for our support.",
    "restarting": "Does it restart at any hour, or only with one program open?\nThank you for noting it down for a day: one program alone is cured by its own update from the store, and anything else the team will check in the logs.",
    "double_charge": "Sorry, nobody should pay twice.\nOnly billing can see your account and compare each charge with its transaction, so support will pass this on to them.",
    "unrecognised_charge": "Sorry, a charge you do not recognize is unsettling.\nSend its details to support; billing will trace the transaction without your having to do more.",
    "cancel_subscription": "Every running subscription has a cancel button on its own page.\nIs it missing, or is the plan still there tomorrow? Then support will end it for you.",
    "store_download": "Sorry that it will not load.\nThe exact words of the error, the model and the version tell support why the download stops.",
}

TEMPLATE_REPLIES = {
    "device_hardware_issue": KNOWN_REPLIES["no_power"],
    "device_storage_issue": KNOWN_REPLIES["storage_intent"],
    "device_how_to": "Gladly! What exactly would you like the phone to do?",
    "software_update_issue": "Two questions to narrow it down, and thank you for your patience.\nWhich release was the update, and does the trouble survive a restart? The team will check what others on that release report.",
    "account_appleid_issue": "We appreciate that this is urgent.\nWrite back which of the two is gone, the password or the number that receives the codes: each has its own way in, and the team will name it.",
    "payment_billing_issue": "Thank you for raising this.\nReply with the day and the amount of the charge, but without card numbers. With those details billing can check the entry, and one of the team will write to you.",
    "card_atm_issue": "Cards are blocked by the bank that issued them, so the number on the back is the one to call first.\nWe understand how awkward that is at a till: share the time of the refused transaction, and the team will check whether the block came from us.",
    "subscription_services": "Which plan is it about? We appreciate its exact name, since trials and bundles end differently.\nAll of them stand under your account in Settings with the day of the next renewal, and the team can undo a subscription begun by mistake.",
    "app_store_issue": "Thank you for telling us. Does one title fail, or every download?\nA single one is usually withdrawn or too new for the phone; if all of them hang, a restart clears the queue. Support reads along here.",
    "order_shipping_issue": "Parcels change hands twice on the way, and the page often lags a day behind.\nWe understand the wait is hard: send the order number and the details of the address, and the team will check with the depot where it lies.",
    "other_general": "Hello, and thank you for writing.\nIs it about a device, a payment or an order? One sentence on what happened is enough for the team to pick it up.",
}
DAMAGE_REPLY = KNOWN_REPLIES["physical_damage"]
GENERATION_ERROR_REPLY = "Sorry, something went wrong on our side. Send us a DM and the team will answer."

OVERRIDE_REASONING = {
    "how_to_request": "Asks for the steps to a feature",
    "disputed_charge": "Questions a payment as not their own",
}
NO_HIT_REASONING = "Without any keyword the general label is used"
HIT_REASONING = "Label with the most keywords (%d)"
MODEL_FALLBACK_PREFIX = "Rules used, model answer unusable (%s): "

SUPPORT_REASONS = {
    "known": "The reply is a reviewed answer to exactly this request.",
    "template": "Only a general text for this label was at hand.",
    "model_grounded": "The drafted reply says nothing that the past cases do not.",
    "model_ungrounded": "Parts of the drafted reply go beyond the past cases: have it read first.",
    "model_failed": "There is no drafted reply.",
}

GROUNDING_REASONS = {
    "no_evidence": "Nothing similar was found to compare the reply with.",
    "no_action": "Apart from contacting us, the reply proposes nothing that could be compared.",
    "unsupported_action": "At least one proposed step is missing from the past replies.",
    "supported": "Each proposed step appears in the past replies.",
}
GROUNDING_DEFAULT_REASON = "No reason was given."

ROUTING_REASONS = {
    "risk_compromised": "Possible takeover: for the account security desk.",
    "risk_duplicate": "Possible double payment: for somebody who can open the ledger.",
    "risk_unrecognised": "Possible fraud: for the payments desk.",
    "risk_generic": "Words of crime, law or danger: for a person.",
    "dead_device": "A device that died while updating: no safe remote step is known.",
    "sensitive_duplicate": "Possible double payment: for somebody who can open the ledger.",
    "sensitive_billing": "Money is involved: for the payments desk.",
    "sensitive_account": "The sender must be identified first.",
    "low_confidence": "The label is too uncertain.",
    "how_to_no_evidence": "Harmless instructions, given without a comparable case.",
    "no_evidence": "No comparable case exists.",
    "how_to_weak_evidence": "Harmless instructions, though the cases are only loosely comparable.",
    "weak_evidence": "The cases are only loosely comparable.",
    "unsupported_answer": "No reviewed answer covers the message.",
    "ungrounded": "The reply goes beyond what past replies did.",
    "standard": "A routine matter with comparable cases.",
    "other": "Label '%s' is certain enough and has comparable cases.",
}
REPORT_HARDWARE_REASON = "A routine matter that the customer can try at home."

JUDGE_REASONING = "Scored by markers, not by a model"
JUDGE_FALLBACK_PREFIX = "Scored by markers after an unusable answer (%s): "

GOLDEN_LABEL_SOURCE = "keyword_candidate"
GOLDEN_REVIEW_STATUS = "needs_review"
GOLDEN_NOTES = "Sampled by keyword label; a person must confirm it."

NO_EVIDENCE_BLOCK = "<cases/>"
JUDGE_NO_EVIDENCE_BLOCK = "<cases/>"
# One past case in a prompt, and what stands between cases.
CASE_BLOCK = """<case rank="{rank}" score="{score}">
<answer>{answer}</answer>
<question>{question}</question>
<thread{cut}>{thread}</thread>
</case>"""
CASE_CUT_MARK = " shortened"
JUDGE_CASE_BLOCK = """<case rank="{rank}"><answer>{answer}</answer><question>{question}</question></case>"""
CASE_SEPARATOR = "\n"

INTENT_PROMPT = """You sort the inbox of a support desk. These are its pigeonholes and what goes into each:
{taxonomy}

Return a JSON object of four fields. "intent" is the pigeonhole of the colleague who should open the
message first. "intents" is an array of the pigeonholes of everybody who will have work with it, in
the order of that work. "confidence" is a fraction: of many colleagues, how many would have sorted
the message as you did? "reasoning" quotes the words that decided.

The next message reads:
{message}"""

REPLY_PROMPT = """A customer wrote to us about {intent}:
{message}

Solved cases that resemble it, nearest first:
{evidence}

Find the solved case that asks what the customer asks. Retell its answer in fresh words and in the
same order, no longer than a text message. Where no case asks the same, ask for the one fact that
would tell which of them applies. Every number, date, name and address you write down has to stand
in a case or in the message. Your output goes to the customer unchanged."""

GROUNDING_PROMPT = """Audit a reply against solved cases.

The reply:
{reply}

The solved cases:
{evidence}

Go through the reply and note each thing that it asks of the customer or announces. Tick it off if
the answer of some case asks or announces the same. Report as JSON with two fields: "grounded" is
true if nothing is left without a tick, false if something is; "reason" names the first thing
without a tick, or else the case that covers the most."""

JUDGE_PROMPT = """Score a support reply from 1 (worst) to 5 (best) on five dimensions:
correctness, groundedness, helpfulness, tone, and hallucination (5 means nothing invented).

Answer with one JSON object: the five names as integers, and "reasoning" as one sentence.

Customer message:
{message}

Past cases:
{evidence}

Reply:
{reply}"""

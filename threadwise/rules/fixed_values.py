"""Fixed values.

Labels, keywords, patterns, term groups, markers and thresholds in this file decide results
and must not be altered for results to stay comparable. They are plain data: the code that
uses them is elsewhere, and a caller may supply a different pack.
"""

# --- intents: (name, default action, keywords), in taxonomy order ---------------------------
INTENTS = (
    ("device_hardware_issue", "AUTO_HANDLE", (
        "battery", "screen", "charge", "charger", "charging", "heat", "hot", "overheating",
        "overheat", "speaker", "mic", "camera", "button", "display", "drain", "turn on",
        "turned on", "power on", "won't turn on", "wont turn on", "restart", "restarting",
        "reboot", "reboots", "rebooting",
    )),
    ("software_update_issue", "AUTO_HANDLE", (
        "update", "ios", "version", "freeze", "freezing", "lag", "lagging", "slow", "stuck",
        "reboot", "loop", "crash", "downloading",
    )),
    ("device_storage_issue", "AUTO_HANDLE", (
        "storage", "storage is full", "space", "free up space", "low storage", "full",
    )),
    ("device_how_to", "AUTO_HANDLE", (
        "screenshot", "screen shot", "screen capture", "how to", "how do i",
        "take a picture of my screen", "delete an app", "delete a app", "delete app",
        "remove app", "uninstall app", "screen recording", "record my screen",
        "turn on wifi", "enable wifi", "dark mode", "update ios", "update my iphone",
    )),
    ("account_appleid_issue", "ESCALATE", (
        "appleid", "apple id", "apple account", "recover", "recovery", "password", "icloud",
        "locked", "disabled", "security", "verification", "code", "2fa", "sign in", "login",
    )),
    ("payment_billing_issue", "ESCALATE", (
        "charge", "charged", "billing", "payment", "refund", "card", "bank", "money",
        "receipt", "purchase", "declined", "invoice",
    )),
    ("card_atm_issue", "ESCALATE", (
        "debit card", "credit card", "debit", "credit", "atm", "cash withdrawal",
        "cash machine", "cash", "card declined",
    )),
    ("subscription_services", "AUTO_HANDLE", (
        "subscription", "music", "tv+", "arcade", "icloud+", "cancel", "trial", "plan",
        "membership", "renew",
    )),
    ("app_store_issue", "AUTO_HANDLE", (
        "app", "apps", "store", "download", "downloading", "install", "installing",
        "update app", "whatsapp", "instagram", "twitter",
    )),
    ("order_shipping_issue", "AUTO_HANDLE", (
        "order", "shipping", "delivery", "track", "tracking", "pickup", "store", "trade-in",
        "delivery date", "shipment", "arriving",
    )),
    ("other_general", "AUTO_HANDLE", (
        "help", "thanks", "hello", "hi", "question", "feedback", "feature", "suggestion",
    )),
)
FALLBACK_INTENT = "other_general"

# --- intent display labels -------------------------------------------------------------------
LABELS = {
    "device_hardware_issue": "Device Troubleshooting",
    "device_storage_issue": "Device Storage",
    "device_how_to": "Device How-To",
    "software_update_issue": "Software Update",
    "account_appleid_issue": "Apple ID and Account Access",
    "payment_billing_issue": "Billing and Purchases",
    "card_atm_issue": "Card and ATM Issues",
    "subscription_services": "Subscriptions",
    "app_store_issue": "App Store",
    "order_shipping_issue": "Orders and Delivery",
    "other_general": "General Support",
}
DUPLICATE_CHARGE_LABEL = "Apple Purchase Billing - Duplicate Charge"
DUPLICATE_CHARGE_LABEL_PATTERN = (
    r"\b(charged twice|duplicate charge|double charge|charged me twice)\b"
)

# --- confidence --------------------------------------------------------------------------------
CONFIDENCE_BASE = 0.55
CONFIDENCE_PER_HIT = 0.08
CONFIDENCE_CEILING = 0.88
CONFIDENCE_NO_HIT = 0.30
MAX_INTENTS = 3

# --- intent overrides: (rule, intent, all patterns must occur) -----------------------------------
OVERRIDES = (
    ("how_to_request", "device_how_to", (
        r"\b(how to|how do i|how can i)\b",
        r"\b(screenshot|screen shot|screen capture|delete|remove|uninstall|record|wi[- ]?fi|dark mode|update|storage|app)\b",
    )),
    ("disputed_charge", "payment_billing_issue", (
        r"\b(i don't recognize|i do not recognize|don't remember making|do not remember making|unauthorized|why did apple charge|apple transaction)\b",
        r"\b(charge|charged|purchase|transaction|payment)\b",
    )),
)

# --- messages that never need a model: (intents, any pattern; no pattern = always) ------------------
SETTLED = (
    (("payment_billing_issue",), (
        r"\b(i don't recognize|i do not recognize|don't remember making|do not remember making|unauthorized|why did apple charge|apple transaction)\b",
    )),
    (("account_appleid_issue", "device_storage_issue", "device_hardware_issue"), (
        r"\b(recover|recovery|forgot|reset|apple account|apple id)\b",
        r"\b(storage|free up space|low storage)\b",
        r"\b(hot|overheating|overheat|won'?t turn on|no power|restart|restarting|reboots|rebooting)\b",
        r"\b(screenshot|screen shot|screen capture|picture of my screen)\b",
    )),
    (("device_how_to",), ()),
)

# --- known-issue reply rules: (rule, intents or () for any, all patterns must occur), first match wins --
REPLY_RULES = (
    ("storage_intent", ("device_storage_issue",), ()),
    ("storage_text", (), (r"\b(storage|free up space|low storage|storage is full)\b",)),
    ("screen_capture", ("device_how_to",), (r"\b(screenshot|screen shot|screen capture|picture of my screen)\b",)),
    ("remove_app", ("device_how_to",), (r"\b(delete|remove|uninstall)\b.*\b(app|application)\b",)),
    ("record_screen", ("device_how_to",), (r"\b(screen recording|record my screen|record the screen)\b",)),
    ("connect_wifi", ("device_how_to",), (
        r"\b(turn on|enable|connect to)\b.*\b(wi[- ]?fi)\b|\b(wi[- ]?fi)\b.*\b(turn on|enable|connect)\b",
    )),
    ("dark_theme", ("device_how_to",), (r"\b(dark mode|dark theme)\b",)),
    ("update_system", ("device_how_to",), (r"\b(update ios|update my iphone|update my phone|software update)\b",)),
    ("recover_password", ("account_appleid_issue",), (
        r"\b(recover|recovery|forgot|reset|can't access|cannot access)\b",
        r"\b(password|passcode)\b",
    )),
    ("recover_account", ("account_appleid_issue",), (r"\b(recover|recovery|forgot|reset|can't access|cannot access)\b",)),
    ("account_compromised", ("account_appleid_issue",), (
        r"\b(hacked|compromised|changed my password|changed my apple account password|unauthorized access)\b",
    )),
    ("boot_loop", (), (r"\b(stuck on the apple logo|boot loop|keeps rebooting)\b",)),
    ("dead_after_update", ("device_hardware_issue",), (
        r"\b(black screen|screen is completely black|won'?t turn on|doesn'?t turn on)\b",
        r"\b(update|ios)\b",
    )),
    ("physical_damage", ("device_hardware_issue",), (r"\b(crack|cracked|broken|shatter|shattered)\b",)),
    ("no_power", ("device_hardware_issue",), (r"\b(won'?t turn on|doesn'?t turn on|no power|power on)\b",)),
    ("no_charge", (), (r"\b(won'?t charge|doesn'?t charge|not charging|charge issue)\b",)),
    ("overheating", ("device_hardware_issue",), (r"\b(hot|overheating|overheat)\b",)),
    ("restarting", ("device_hardware_issue", "software_update_issue"), (
        r"\b(restart|restarting|reboot|reboots|rebooting)\b",
    )),
    ("double_charge", ("payment_billing_issue",), (r"\b(charged twice|double charge|duplicate charge|twice)\b",)),
    ("unrecognised_charge", ("payment_billing_issue",), (
        r"\b(i don't recognize|i do not recognize|don't remember making|do not remember making|unauthorized|unknown)\b",
    )),
    ("cancel_subscription", ("subscription_services",), (r"\b(cancel|cancellation|unsubscribe|stop|end)\b",)),
    ("store_download", ("app_store_issue",), (r"\b(download|install|error|cannot|can't)\b",)),
)
DAMAGE_INTENT = "device_hardware_issue"
DAMAGE_PATTERN = r"\b(crack|cracked|broken|shatter|shattered)\b"
KNOWN_MODEL = "deterministic_issue_handler"
TEMPLATE_MODEL = "template_fallback"

# --- action groups for grounding --------------------------------------------------------------------
ACTION_GROUPS = {
    "restart": ("restart", "restarting", "reboot", "reboots", "rebooting"),
    "charge": ("charge", "charging", "charger", "power"),
    "charging_accessory": ("cord", "cords", "cable", "cables", "port", "ports"),
    "settings": ("settings", "setting"),
    "contact_support": ("support", "team", "contact", "help"),
    "account": ("account", "password", "credentials", "verify", "recovery"),
    "purchase": ("purchase", "billing", "transaction", "receipt", "charged"),
    "download": ("download", "install", "app", "store"),
    "subscription": ("subscription", "subscriptions", "manage", "cancel"),
    "request_details": ("share", "model", "version", "happened", "details"),
}
CONTACT_GROUP = "contact_support"

# --- routing --------------------------------------------------------------------------------------------
RISK_PATTERNS = (
    r"\bfraud\b",
    r"\bhacked\b",
    r"\bunauthorized\b",
    r"\bstolen\b",
    r"\bsue\b",
    r"\blawsuit\b",
    r"\bthreaten\b",
    r"\blegal\b",
    r"\bpolice\b",
    r"\brefund.{0,20}not.{0,20}receiv",
    r"\bcharged.{0,20}twice\b",
    r"\bidentity.{0,20}theft\b",
    r"\baccoun.{0,10}compromis",
    r"\bpassword.{0,15}stolen\b",
)
SHIPPING_INTENT = "order_shipping_issue"
SHIPPING_LOSS_PATTERN = r"\b(stolen|lost|missing)\b"
SHIPPING_TRACK_PATTERN = r"\b(track|tracking|shipment|delivery|serial number)\b"
RISK_COMPROMISED_PATTERN = r"\b(hacked|compromis|changed my password|account takeover)\b"
RISK_DUPLICATE_PATTERN = r"\b(charged.{0,20}twice|duplicate charge|double charge)\b"
RISK_UNRECOGNISED_PATTERN = (
    r"\b(i don't recognize|i do not recognize|don't remember making|unauthorized|unknown)\b"
)
DEAD_DEVICE_INTENTS = ("device_hardware_issue", "software_update_issue")
DEAD_DEVICE_CONTEXT_PATTERNS = (
    r"\b(update|ios|after updating|after the update)\b",
    r"\b(stuck on the apple logo|unresponsive|boot loop)\b",
)
DEAD_DEVICE_SYMPTOM_PATTERN = (
    r"\b(black screen|completely black|won'?t turn on|stuck on the apple logo|unresponsive|boot loop)\b"
)
SENSITIVE_INTENTS = ("account_appleid_issue", "payment_billing_issue", "card_atm_issue")
BILLING_INTENT = "payment_billing_issue"
BILLING_DUPLICATE_PATTERN = r"\b(charged.{0,20}twice|duplicate charge|double charge|twice)\b"
HOW_TO_INTENT = "device_how_to"
STANDARD_INTENTS = (
    "device_hardware_issue", "device_storage_issue", "device_how_to",
    "software_update_issue", "app_store_issue", "subscription_services",
)
CONFIDENCE_THRESHOLD = 0.60
RETRIEVAL_THRESHOLD = 0.35

# --- retrieval ---------------------------------------------------------------------------------------------
MAX_FEATURES = 20_000
BASELINE_MAX_FEATURES = 5_000
MIN_SIMILARITY = 0.01
AGENT_TOP_K = 5
REPORT_TOP_K = 3

# --- reply scoring markers: plain substrings --------------------------------------------------------------------
EMPATHY_MARKERS = ("sorry", "understand", "happy to help", "appreciate", "thank")
ACTION_MARKERS = ("dm", "direct message", "settings", "restart", "update", "check")
PROMISE_MARKERS = (
    "will refund", "guarantee", "within 24 hours", "within 48 hours", "100%", "definitely",
    "we promise",
)

# --- evaluation sets -----------------------------------------------------------------------------------------------
GOLDEN_TOTAL = 200
GOLDEN_MIN_QUERY_LENGTH = 15
GOLDEN_ROW_RANGE = (150, 250)
TRAINING_ROWS = 10_000
RATING_TEMPLATE_ROWS = 50
SEED = 42

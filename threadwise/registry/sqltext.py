"""SQL text for the checks, written independently of the Spark operators.

Rules are tables of patterns here and joins find the first match, whereas the operators compile
them to CASE chains. Only the rule data itself is shared.
"""

from __future__ import annotations

from threadwise.registry import inputs
from threadwise.rules import fixed_values as fixed
from threadwise.rules import wording
from threadwise.rules.pack import SUPPORT_PACK
from threadwise.rules.stop_words import ENGLISH

SPACES = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def hit_reasoning(count: str) -> str:
    return f"printf({lit(wording.HIT_REASONING)}, {count})"


def rows(name: str, columns: str, values: list[tuple]) -> str:
    """A literal table as a CTE."""
    def cell(value):
        if value is None or isinstance(value, str):
            return lit(value)
        return str(value)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in values)
    return f"{name}({columns}) AS (VALUES {body})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(cte.strip() for cte in ctes)


def clean(expr: str) -> str:
    """Unescape the common entities, collapse white space, trim."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                          ("&nbsp;", " "), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{plain}')"
    return f"trim(regexp_replace({expr}, '{SPACES}+', ' ', 'g'))"


def strip_handles(expr: str) -> str:
    rest = rf"trim(regexp_replace({clean(expr)}, '^(?:@[\p{{L}}\p{{N}}_]+{SPACES}*)+', ''))"
    return f"coalesce(nullif({rest}, ''), {expr})"


def ascii_words(expr: str) -> str:
    """Lower-case with foreign letters and digits as underscores, so that \\b is right."""
    return rf"regexp_replace(lower({expr}), '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]', '_', 'g')"


def found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def found_all(text: str, patterns) -> str:
    return " AND ".join(found(text, p) for p in patterns) if patterns else "TRUE"


def in_list(expr: str, values) -> str:
    return f"{expr} IN (" + ", ".join(lit(v) for v in values) + ")"


def case(cases: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


# --- intents ---------------------------------------------------------------------------------

def _keyword_pattern(keyword: str) -> str:
    return r"\b" + keyword.replace("+", r"\+").replace("-", r"\-") + r"\b"


KEYWORDS = rows(
    "keywords", "ord, intent, pattern",
    [
        (i, intent.name, _keyword_pattern(keyword))
        for i, intent in enumerate(SUPPORT_PACK.intents)
        for keyword in intent.keywords
    ],
)
TAXONOMY = rows(
    "taxonomy", "ord, intent, default_action, label",
    [(i, x.name, x.default_action, x.label) for i, x in enumerate(SUPPORT_PACK.intents)],
)

_OVERRIDE = case(
    [(found_all("lo", rule.patterns), lit(rule.name)) for rule in SUPPORT_PACK.overrides], "NULL"
)


def by_override(values, otherwise: str) -> str:
    return case(
        [(f"override_name = {lit(r.name)}", values(r)) for r in SUPPORT_PACK.overrides], otherwise
    )


_SETTLED = " OR ".join(
    "("
    + in_list("intent", entry.intents)
    + (" AND (" + " OR ".join(found("lo", p) for p in entry.patterns) + ")" if entry.patterns else "")
    + ")"
    for entry in SUPPORT_PACK.settled
)


def scored(source: str, key: str, text: str) -> str:
    """CTEs lowered, hits, ranked, best over any table of texts."""
    return f"""{KEYWORDS},
{TAXONOMY},
lowered AS (SELECT *, {ascii_words(text)} AS lo FROM {source}),
hits AS (
  SELECT l.{key}, k.ord, k.intent, count(*) AS hits
  FROM lowered l JOIN keywords k ON regexp_matches(l.lo, k.pattern)
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY hits DESC, ord) AS place,
         max(hits) OVER (PARTITION BY {key}) AS best
  FROM hits),
best AS (
  SELECT {key}, max(best) AS best,
         max(CASE WHEN place = 1 THEN intent END) AS intent,
         string_agg(intent, '|' ORDER BY place)
           FILTER (hits >= greatest(1, best - 1) AND place <= 3) AS intents
  FROM ranked GROUP BY {key})"""


CLASSIFIED = inputs.MESSAGES + ",\n" + scored("messages", "msg_id", "message") + f""",
overridden AS (
  SELECT l.*, b.best, b.intent AS kw_intent, b.intents AS kw_intents, {_OVERRIDE} AS override_name
  FROM lowered l LEFT JOIN best b USING (msg_id)),
classified_base AS (
  SELECT msg_id, conv_id, message, lo, override_name, coalesce(best, 0) AS best,
    {by_override(lambda r: lit(r.intent), "coalesce(kw_intent, 'other_general')")} AS intent,
    {by_override(lambda r: lit(r.intent), "coalesce(kw_intents, 'other_general')")} AS intents,
    {by_override(lambda r: "0.88", "CASE best WHEN 1 THEN 0.63 WHEN 2 THEN 0.71 WHEN 3 THEN 0.79 WHEN 4 THEN 0.87 ELSE CASE WHEN best >= 5 THEN 0.88 ELSE 0.30 END END")}::DOUBLE AS confidence,
    {by_override(lambda r: lit(r.reasoning), "CASE WHEN best > 0 THEN " + hit_reasoning("best") + " ELSE " + lit(wording.NO_HIT_REASONING) + " END")} AS reasoning
  FROM overridden),
classified AS (SELECT *, NOT ({_SETTLED}) AS needs_model FROM classified_base)"""


# --- TF-IDF ------------------------------------------------------------------------------------

def stop_list() -> str:
    return ", ".join(map(lit, ENGLISH))


def tokens(text: str) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), "
        f"lambda x: x NOT IN ({stop_list()}))"
    )


def _grams(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_tokens AS (SELECT {key}, {tokens(text)} AS t FROM {source}),
{name}_terms AS (
  SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)),
         lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {name}_tokens),
{name}_counts AS (SELECT {key}, term, count(*) AS tf FROM {name}_terms GROUP BY ALL)"""


def _weights(name: str, key: str) -> str:
    return f"""{name}_raw AS (
  SELECT c.{key}, v.term, (1 + ln(c.tf)) * v.idf AS raw
  FROM {name}_counts c JOIN vocab v USING (term)),
{name}_weights AS (
  SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS w FROM {name}_raw)"""


def tfidf(corpus: str, key: str, text: str, max_features: int = fixed.MAX_FEATURES) -> str:
    """CTEs doc_counts, vocab and doc_weights over a corpus."""
    return f"""{_grams("doc", corpus, key, text)},
vocab_base AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM doc_counts GROUP BY term
  ORDER BY cf DESC, term LIMIT {max_features}),
vocab AS (
  SELECT term, cf, df, ln((1 + (SELECT count(*) FROM {corpus})) / (1 + df)) + 1 AS idf
  FROM vocab_base),
{_weights("doc", key)}"""


def retrieval(corpus: str, doc: str, doc_text: str, queries: str, q: str, q_text: str, k: int) -> str:
    """CTEs up to ``retrieved``: every shared term is joined, nothing is pruned."""
    return f"""{tfidf(corpus, doc, doc_text)},
{_grams("query", queries, q, q_text)},
{_weights("query", q)},
pair_scores AS (
  SELECT a.{q}, b.{doc}, round(sum(a.w * b.w), 10) AS similarity
  FROM query_weights a JOIN doc_weights b USING (term) GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY similarity DESC, {doc}) AS rank
  FROM pair_scores),
retrieved AS (
  SELECT {q}, {doc}, rank, similarity, round(similarity, 4) AS similarity_score
  FROM placed WHERE rank <= {k} AND similarity >= {fixed.MIN_SIMILARITY})"""


def support_retrieval(k: int = fixed.AGENT_TOP_K) -> str:
    return retrieval(
        "corpus", "conversation_id", "initial_query", "messages", "msg_id", "message", k
    )


def linear_fit(labels: list[str], steps: int = 1500) -> str:
    """CTEs up to ``linear``: a logistic regression of ``labelled`` fitted again, by other means.

    Every row has a weight per label, which scales its vector; scores come from the inner products
    of rows. Steps along the gradient with momentum end at the optimum of the penalised loss, where
    any other method has to end as well. a and b are weights and intercepts, o and q the ones before.
    """
    names = sorted(labels)
    classes = range(len(names))

    def each(template: str, separator: str = ", ") -> str:
        return separator.join(template.replace("#", str(c)) for c in classes)

    truth = ", ".join(
        f"CAST(label = {lit(name)} AS INTEGER)::DOUBLE AS y{c}, "
        f"count(*) FILTER (label = {lit(name)}) OVER () > 0 AS k{c}"
        for c, name in enumerate(names)
    )
    return f"""grams AS MATERIALIZED (
  SELECT x.msg_id AS i, y.msg_id AS j, sum(x.w * y.w) AS g
  FROM doc_weights x JOIN doc_weights y USING (term) GROUP BY ALL),
rates AS MATERIALIZED (
  SELECT count(*) AS n, 1.0 / count(*) AS shrink,
         (sqrt(count(*)) - 1) / (sqrt(count(*)) + 1) AS beta FROM labelled),
truth AS MATERIALIZED (SELECT msg_id AS i, {truth} FROM labelled),
fit AS (
  SELECT 0 AS step, i, {each("0::DOUBLE AS a#, 0::DOUBLE AS o#, 0::DOUBLE AS b#, 0::DOUBLE AS q#")}
  FROM truth
  UNION ALL
  SELECT step + 1, i,
         {each("(1 - shrink) * v# - d# / n, a#, u# - sum(d#) OVER () / n, b#")}
  FROM (SELECT *, {each("e# / total - y# AS d#")}
    FROM (SELECT *, {each("e#", " + ")} AS total
      FROM (SELECT z.*, {each("y#, CASE WHEN k# THEN exp(coalesce(s#, 0) + u#) ELSE 0 END AS e#")}
        FROM (SELECT x.*, r.*, {each("a# + beta * (a# - o#) AS v#, b# + beta * (b# - q#) AS u#")}
              FROM fit x, rates r WHERE step < {steps}) z
        LEFT JOIN (SELECT g.i AS si, {each("sum(g * (a# + beta * (a# - o#))) AS s#")}
                   FROM fit JOIN rates ON TRUE JOIN grams g ON g.j = fit.i GROUP BY g.i) w
          ON w.si = z.i
        JOIN truth t ON t.i = z.i)))),
linear_scores AS (
  SELECT f.i, [{each("CASE WHEN k# THEN coalesce(s#, 0) + b# ELSE -1e300 END")}] AS scores
  FROM (SELECT * FROM fit WHERE step = {steps}) f JOIN truth t ON t.i = f.i
  LEFT JOIN (SELECT g.i AS si, {each("sum(g * a#) AS s#")}
             FROM (SELECT * FROM fit WHERE step = {steps}) m JOIN grams g ON g.j = m.i
             GROUP BY g.i) w ON w.si = f.i),
linear AS MATERIALIZED (
  SELECT i AS msg_id,
         [{", ".join(map(lit, names))}][list_position(scores, list_max(scores))] AS predicted
  FROM linear_scores)"""


def recursive(query: str) -> str:
    return query.replace("WITH ", "WITH RECURSIVE ", 1)


# --- replies and routing --------------------------------------------------------------------------

REPLY_RULE = case(
    [
        (
            (in_list("intent", rule.intents) + " AND " if rule.intents else "")
            + found_all("lo", rule.patterns),
            lit(rule.name),
        )
        for rule in SUPPORT_PACK.reply_rules
    ],
    "NULL",
)
REPLY_TEXTS = rows(
    "reply_texts", "rule, reply", [(r.name, r.reply) for r in SUPPORT_PACK.reply_rules]
)
TEMPLATES = rows("templates", "intent, reply", [(x.name, x.template) for x in SUPPORT_PACK.intents])
GROUPS = rows(
    "action_terms", "grp, term",
    [(name, term) for name, terms in SUPPORT_PACK.action_groups.items() for term in terms],
)


def term_list(text: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z][a-z'']+')), "
        "lambda x: length(x) >= 4)"
    )


DRAFTED = f"""{REPLY_TEXTS},
{TEMPLATES},
drafted AS (
  SELECT c.*, c.known_rule IS NOT NULL AS answer_supported, coalesce(c.known_rule, c.intent) AS reply_rule,
         CASE WHEN c.known_rule IS NULL THEN 'template' ELSE 'known' END AS reply_source,
         coalesce(r.reply, t.reply) AS reply,
         CASE WHEN c.known_rule IS NULL THEN {lit(wording.SUPPORT_REASONS["template"])}
              ELSE {lit(wording.SUPPORT_REASONS["known"])} END AS support_reason,
         CASE WHEN c.known_rule IS NULL THEN 'template_fallback'
              ELSE 'deterministic_issue_handler' END AS generation_model
  FROM (SELECT *, {REPLY_RULE} AS known_rule FROM classified) c
  LEFT JOIN reply_texts r ON r.rule = c.known_rule
  LEFT JOIN templates t ON t.intent = c.intent)"""

GROUNDED = f"""{GROUPS},
evidence AS (
  SELECT r.msg_id, r.rank, r.similarity_score, c.conversation_id, c.initial_query,
         c.first_support_reply, c.dialogue_head
  FROM retrieved r JOIN corpus c USING (conversation_id)),
evidence_text AS (
  SELECT msg_id, count(*) AS cases, max(similarity_score) AS top,
         string_agg(concat(initial_query, ' ', first_support_reply), ' ' ORDER BY rank) AS body
  FROM evidence GROUP BY msg_id),
evidence_terms AS (
  SELECT msg_id, unnest({term_list("body")}) AS term FROM evidence_text),
reply_terms AS (SELECT msg_id, unnest({term_list("reply")}) AS term FROM drafted),
actions AS (
  SELECT DISTINCT r.msg_id, g.grp FROM reply_terms r JOIN action_terms g USING (term)),
backed AS (
  SELECT DISTINCT e.msg_id, g.grp FROM evidence_terms e JOIN action_terms g USING (term)),
action_check AS (
  SELECT a.msg_id, string_agg(a.grp, '|' ORDER BY a.grp) AS actions,
         count(*) FILTER (a.grp <> 'contact_support') AS meaningful,
         count(*) FILTER (a.grp <> 'contact_support' AND b.grp IS NULL) AS unsupported
  FROM actions a LEFT JOIN backed b USING (msg_id, grp) GROUP BY a.msg_id),
grounded AS (
  SELECT d.*, coalesce(e.cases, 0) AS cases, coalesce(e.top, 0.0) AS top, coalesce(a.actions, '') AS actions,
         CASE WHEN e.cases IS NULL THEN 'no_evidence'
              WHEN coalesce(a.meaningful, 0) = 0 THEN 'no_action'
              WHEN a.unsupported > 0 THEN 'unsupported_action' ELSE 'supported' END AS grounding
  FROM drafted d LEFT JOIN evidence_text e USING (msg_id) LEFT JOIN action_check a USING (msg_id))"""

GROUNDING_REASON = case(
    [(f"grounding = {lit(k)}", lit(v)) for k, v in wording.GROUNDING_REASONS.items()], "NULL"
)

RISK = rows("risks", "ord, pattern", list(enumerate(SUPPORT_PACK.risk_patterns)))
RISK_HIT = (
    "(SELECT arg_min(r.pattern, r.ord) FROM risks r WHERE regexp_matches(lo, r.pattern))"
)
EXEMPT = (
    f"(intent = {lit(fixed.SHIPPING_INTENT)} AND {found('lo', fixed.SHIPPING_LOSS_PATTERN)} "
    f"AND {found('lo', fixed.SHIPPING_TRACK_PATTERN)})"
)
RISK_RULE = case(
    [
        (found("lo", fixed.RISK_COMPROMISED_PATTERN), "'risk_compromised'"),
        (found("lo", fixed.RISK_DUPLICATE_PATTERN), "'risk_duplicate'"),
        (found("lo", fixed.RISK_UNRECOGNISED_PATTERN), "'risk_unrecognised'"),
    ],
    "'risk_generic'",
)
DEAD = (
    f"({in_list('intent', fixed.DEAD_DEVICE_INTENTS)} AND ("
    + " OR ".join(found("lo", p) for p in fixed.DEAD_DEVICE_CONTEXT_PATTERNS)
    + f") AND {found('lo', fixed.DEAD_DEVICE_SYMPTOM_PATTERN)})"
)
SENSITIVE = in_list("intent", SUPPORT_PACK.sensitive_intents)
SENSITIVE_RULE = case(
    [
        (f"intent = 'payment_billing_issue' AND {found('lo', fixed.BILLING_DUPLICATE_PATTERN)}",
         "'sensitive_duplicate'"),
        ("intent = 'payment_billing_issue'", "'sensitive_billing'"),
    ],
    "'sensitive_account'",
)

ROUTED = f"""{RISK},
routed_base AS (
  SELECT *, {GROUNDING_REASON} AS grounding_reason, {RISK_HIT} AS risk, {EXEMPT} AS exempt,
         intent = 'device_how_to' AND answer_supported AND confidence >= 0.6 AS how_to
  FROM grounded),
routed_rule AS (
  SELECT *, CASE
    WHEN risk IS NOT NULL AND NOT exempt THEN {RISK_RULE}
    WHEN {DEAD} THEN 'dead_device'
    WHEN {SENSITIVE} THEN {SENSITIVE_RULE}
    WHEN confidence < 0.6 THEN 'low_confidence'
    WHEN cases = 0 THEN CASE WHEN how_to THEN 'how_to_no_evidence' ELSE 'no_evidence' END
    WHEN top < 0.35 THEN CASE WHEN how_to THEN 'how_to_weak_evidence' ELSE 'weak_evidence' END
    WHEN NOT answer_supported THEN 'unsupported_answer'
    WHEN grounding <> 'supported' AND intent <> 'device_how_to' THEN 'ungrounded'
    WHEN {in_list("intent", SUPPORT_PACK.standard_intents)} THEN 'standard'
    ELSE 'other' END AS rule
  FROM routed_base),
{rows("routing_reasons", "rule, reason", list(wording.ROUTING_REASONS.items()))},
routed AS (
  SELECT b.*,
    CASE WHEN {in_list("b.rule", ("how_to_no_evidence", "how_to_weak_evidence", "standard", "other"))}
         THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS decision,
    CASE WHEN b.rule = 'ungrounded' THEN b.grounding_reason
         ELSE replace(r.reason, '%s', b.intent) END AS reason
  FROM routed_rule b LEFT JOIN routing_reasons r USING (rule))"""


def whole_dialogues(query: str) -> str:
    """A check query whose conversations carry their whole dialogue, not its beginning."""
    whole = query.replace(inputs.DIALOGUE_HEAD, inputs.FULL_DIALOGUE)
    return whole.replace("c.dialogue_head", "c.full_dialogue")


def whole_texts(query: str) -> str:
    """A check query whose messages and dialogues are whole, without fixed phrases in their place."""
    return whole_dialogues(query.replace(inputs.LATE_TEXT, inputs.WHOLE_TEXT))


def triage_ctes(k: int = fixed.AGENT_TOP_K) -> str:
    """Everything up to ``routed``."""
    support = inputs.SUPPORT_CONVERSATIONS[len(inputs.MESSAGES):].lstrip(",\n")
    return ",\n".join([CLASSIFIED, support, support_retrieval(k), DRAFTED, GROUNDED, ROUTED])

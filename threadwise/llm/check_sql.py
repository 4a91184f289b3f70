"""SQL that must give the rows of the registered queries, for the operators SQL can express."""

from __future__ import annotations

import re

from threadwise.llm.license_templates import PHRASE_WEIGHT, PHRASES, TEMPLATES

OP5_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS o
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM totals),
filled AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k
  FROM weighted),
levels AS (
  SELECT *,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
            ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled),
targets AS (
  SELECT source, source_size,
         least((SELECT level FROM levels WHERE level <= 3 * source_size / w ORDER BY k LIMIT 1) * w,
               CAST(3 * source_size AS DOUBLE)) AS target
  FROM levels),
ends AS (
  SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY o ROWS UNBOUNDED PRECEDING) AS end_at
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT *, (end_at + turn * source_size) / target AS finish
  FROM ends, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, o ROWS UNBOUNDED PRECEDING) AS through FROM turns),
chosen AS (
  SELECT doc_id, o, sum(size) AS taken FROM queue
  WHERE through <= (SELECT sum(size) FROM sized) GROUP BY doc_id, o)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
FROM ends e LEFT JOIN chosen c ON e.o = c.o AND e.doc_id IS NOT DISTINCT FROM c.doc_id
"""

OP3_LINE_QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
repeats AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM windows)
  WHERE n > 1),
repeated AS (
  SELECT r, count(DISTINCT place) AS n
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM repeats) GROUP BY r),
line_rows AS (
  SELECT source, t,
         md5(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D0-9]+', ' ', 'g'))) AS key,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT source, t, unnest(lines) AS line FROM (SELECT DISTINCT source, t, lines FROM w))),
hosts AS (SELECT source, count(DISTINCT t) AS documents FROM line_rows GROUP BY source),
frequent AS (
  SELECT s.source, s.key FROM line_rows s
  JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source
  GROUP BY s.source, s.key, h.documents
  HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > sqrt(h.documents)),
removed AS (
  SELECT l.source, l.t, sum(l.n) AS n
  FROM line_rows l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.key = f.key
  GROUP BY l.source, l.t),
measured AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, coalesce(m.n, 0) AS gone
  FROM w LEFT JOIN repeated p USING (r)
  LEFT JOIN removed m ON w.source IS NOT DISTINCT FROM m.source AND w.t = m.t),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         gone > 0 AND (n_words - gone < 50 AND n_words - gone < 0.5 * n_words
                       OR n_words - gone < 0.2 * n_words) AS depleted
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT depleted AS kept
FROM judged
"""

OP6_ONEBIT_SEARCH = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.v) + 1),
                     lambda i: q.v[i] * c.v[i])), lambda a, b: a + b) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
         AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 20
"""

OP12_MERKLE = r"""
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS grp,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                                   lambda c: CAST(ascii(c) AS BIGINT))),
           lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1],
                                    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
         4294967295) AS crc
  FROM documents),
digests AS (
  SELECT r, doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(CASE WHEN crc % 3 = 0 THEN strlen(low) || ':' || low
                                      ELSE strlen(text) || ':' || text END, '-')) AS found
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY grp) AS n
  FROM digests),
tree AS (
  SELECT grp, 0 AS storey, place, leaf AS node, n FROM leaves
  UNION ALL
  SELECT grp, storey + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8
  FROM tree WHERE n > 1 GROUP BY grp, storey, place // 8, n),
subroots AS (
  SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS storey, place, node, n FROM subroots
  UNION ALL
  SELECT storey + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8
  FROM top WHERE n > 1 GROUP BY storey, place // 8, n),
near AS (
  SELECT l.r, t.storey, t.place, l.place // CAST(power(8, t.storey) AS BIGINT) AS own, t.node
  FROM leaves l JOIN tree t ON l.grp = t.grp AND t.n > 1
    AND t.place // 8 = l.place // CAST(power(8, t.storey + 1) AS BIGINT)
  UNION ALL
  SELECT l.r, 1000 + t.storey, t.place, s.place // CAST(power(8, t.storey) AS BIGINT), t.node
  FROM leaves l JOIN subroots s ON l.grp = s.grp JOIN top t ON t.n > 1
    AND t.place // 8 = s.place // CAST(power(8, t.storey + 1) AS BIGINT)),
steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY storey) AS step,
         coalesce(string_agg(node, '' ORDER BY place) FILTER (WHERE place < own), '') AS lefts,
         coalesce(string_agg(node, '' ORDER BY place) FILTER (WHERE place > own), '') AS rights
  FROM near GROUP BY r, storey),
proofs AS (
  SELECT r, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof, max(step) AS last
  FROM steps GROUP BY r),
folded AS (
  SELECT r, 0 AS step, found AS node FROM leaves
  UNION ALL
  SELECT f.r, f.step + 1, sha256(lefts || f.node || rights)
  FROM folded f JOIN steps s ON s.r = f.r AND s.step = f.step + 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, top.node AS root,
       coalesce(p.proof, sha256('')) AS proof_sha256, f.node AS folded_root,
       f.node = top.node AS verified
FROM leaves l JOIN subroots s ON l.grp = s.grp JOIN top ON top.n = 1
LEFT JOIN proofs p ON p.r = l.r
JOIN folded f ON f.r = l.r AND f.step = coalesce(p.last, 0)
"""

OP13_HARD_NEGATIVES = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10
              ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding,
                        lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1),
                                               lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.r <> c.r AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, c) AS place
  FROM pairs WHERE same),
ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id,
         n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.a, p.place
                                 ORDER BY n.score DESC, n.vec_id NULLS LAST, n.c) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON p.a = n.a AND NOT n.same
    AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""


def _template_pattern(markup: str) -> str:
    """A template as a regular expression over lower-case words, each with a space behind it."""
    parts = []
    for token in re.findall(r"<<[^>]*>>|[0-9A-Za-z]+(?:\|[0-9A-Za-z]+)*", markup):
        if token.startswith("<<begin"):
            parts.append("(?:")
        elif token.startswith("<<end"):
            parts.append(")?")
        elif token.startswith("<<var"):
            low, high = re.findall(r"[0-9]+", token)[-2:]
            parts.append(f"(?:[^ ]+ ){{{low},{high}}}")
        else:
            parts.append(f"(?:{token.lower()}) " if "|" in token else token.lower() + " ")
    return " " + "".join(parts)


_ACCEPTED = ",\n    ".join(
    f"CASE WHEN regexp_matches(line, '{_template_pattern(markup)}') "
    f"THEN {{'label': '{label}', 'weight': {weight}::DOUBLE}} END"
    for label, weight, markup in TEMPLATES
)
_PLACES = ",\n    ".join(
    f"list_transform(list_filter(range(1, len(words) + 1), "
    f"lambda i: words[i:i + {len(phrase.split()) - 1}] = {phrase.split()!r}), "
    f"lambda i: {{'label': '{label}', 'word': i - 1}})"
    for phrase, label in PHRASES
)
OP11_LICENSE_SCAN = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
lines AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM split),
found AS (
  SELECT doc_id, words, flatten([
    {_PLACES}]) AS base,
    list_filter([
    {_ACCEPTED}], lambda x: x IS NOT NULL) AS accepted
  FROM lines),
labelled AS (
  SELECT doc_id, len(words) AS n_words, base, accepted,
         list_transform(base, lambda x: x.label) AS base_list,
         list_transform(accepted, lambda x: x.label) AS own_list
  FROM found)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
       CAST(list_min(list_transform(base, lambda x: x.word)) AS BIGINT) AS first_word,
       CAST(list_max(list_transform(base, lambda x: x.word)) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(base_list)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base_list, own_list))), ',') AS labels,
       greatest(coalesce(list_max(list_transform(accepted, lambda x: x.weight)), 0),
                CASE WHEN len(base) > 0 THEN {PHRASE_WEIGHT} ELSE 0 END)::DOUBLE AS score
FROM labelled
"""

SQL = {
    "op3_line_quality": OP3_LINE_QUALITY,
    "op5_mixing": OP5_MIXING,
    "op6_onebit_search": OP6_ONEBIT_SEARCH,
    "op11_license_scan": OP11_LICENSE_SCAN,
    "op12_merkle": OP12_MERKLE,
    "op13_hard_negatives": OP13_HARD_NEGATIVES,
}

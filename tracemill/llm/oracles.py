"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

import re

from . import licenses, mixing, quality
from .common import LOWER, UPPER

_WS = r"[\x20\x09-\x0D]+"


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({names})"


def _lower(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


OP1 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
ln AS (SELECT doc_id, source, md5(text) AS body, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY 1),
wd AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM d),
tri AS (SELECT doc_id, pos, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM rep) GROUP BY 1),
nl AS (SELECT doc_id, source, body, pos, trim(regexp_replace({_lower('line')}, '{_WS}', ' ', 'g')) AS line FROM ln),
fr AS (SELECT source, line FROM nl WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT body) > {quality.MAX_LINE_DOCS}),
rm AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS removed_words FROM nl JOIN fr USING (source, line) GROUP BY 1),
st AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
 FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN rm USING (doc_id)),
bf AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM st)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {quality.MIN_KEPT_SHARE} * n_words OR n_words - removed_words < {quality.MIN_KEPT_WORDS})) AS kept FROM bf
"""


def op2(rules: list[tuple[str, str, str]]) -> str:
    return f"""
WITH r AS (SELECT * FROM {_values(rules, 'rh, rp, rv')}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(regexp_replace(rest, '^[^/?#]+', ''), '^[^?#]*') AS path FROM u)
SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, coalesce(arg_max(rv, length(rh || rp) * 1000 + length(rh)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path
"""


def op8() -> str:
    known = list(licenses.known_sentences().items())
    rules = [(k, name, " " + " (?:.* )?".join(map(re.escape, ids)).replace("\\-", "-") + " ") for k, (name, ids) in enumerate(licenses.all_rules())]
    body = "text"
    for pattern, by in licenses.READING:
        body = f"regexp_replace({body}, '{pattern}', E'{by.replace('$', chr(92) * 2).replace(chr(10), chr(92) + 'n')}', 'g')"
    return f"""
WITH k AS (SELECT * FROM {_values(known, 'sentence, sentence_id')}), ru AS (SELECT * FROM {_values(rules, 'k, name, pattern')}),
rd AS (SELECT doc_id, 0 AS reading, text AS body FROM documents UNION ALL SELECT doc_id, 1, {body} FROM documents),
se AS (SELECT doc_id, reading, unnest(regexp_split_to_array(body, '{licenses.SENTENCE_END}')) AS raw, generate_subscripts(regexp_split_to_array(body, '{licenses.SENTENCE_END}'), 1) AS pos FROM rd),
pl AS (SELECT doc_id, reading, pos, trim(regexp_replace({_lower('raw')}, '[^a-z0-9]+', ' ', 'g')) AS s FROM se),
ex AS (SELECT doc_id, reading, pos, CASE WHEN starts_with(s, '{licenses.SPDX} ') THEN ['{licenses.SPDX} ' || x FOR x IN regexp_split_to_array(replace(substr(s, {len(licenses.SPDX) + 2}), ' or later', '{licenses.OR_LATER}'), '{licenses.SPDX_JOIN}')] ELSE [s] END AS ss FROM pl),
ids AS (SELECT DISTINCT doc_id, reading, pos, sentence_id FROM (SELECT doc_id, reading, pos, unnest(ss) AS s FROM ex) JOIN k ON sentence = s),
sq AS (SELECT doc_id, reading, count(*) AS n, string_agg(sentence_id, ',' ORDER BY pos, sentence_id) AS ids, ' ' || string_agg(sentence_id, '  ' ORDER BY pos, sentence_id) || ' ' AS sequence FROM ids GROUP BY ALL),
ft AS (SELECT doc_id, name, min(k) AS k FROM sq JOIN ru ON regexp_matches(sequence, pattern) GROUP BY ALL),
li AS (SELECT doc_id, arg_min(name, k) AS licence, string_agg(name, ',' ORDER BY k) AS licences FROM ft GROUP BY 1),
bs AS (SELECT doc_id, arg_max(ids, n * 2 - reading) AS sentence_ids, arg_max(n, n * 2 - reading) AS n_sentences FROM sq GROUP BY 1)
SELECT doc_id, licence, coalesce(licences, '') AS licences, n_sentences, sentence_ids FROM bs LEFT JOIN li USING (doc_id)
"""


OP9 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
nb AS (SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
w0 AS (SELECT doc_id, pos AS lo, lead(pos, 2) OVER o AS hi, row_number() OVER o AS k, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS w FROM nb WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT * FROM w0 WHERE hi IS NOT NULL),
fi AS (SELECT w, min((doc_id, k)) AS f, arg_min(lo, (doc_id, k)) AS flo, arg_min(hi, (doc_id, k)) AS fhi, arg_min(doc_id, (doc_id, k)) AS fd FROM w GROUP BY 1 HAVING count(*) > 1),
rm AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS p, fd = doc_id AS own, flo, fhi FROM w JOIN fi USING (w) WHERE (doc_id, k) <> f),
rp AS (SELECT DISTINCT doc_id, p FROM rm WHERE NOT (own AND p BETWEEN flo AND fhi)),
ra AS (SELECT doc_id, count(*) AS n_removed, string_agg(p, ',' ORDER BY p) AS removed FROM rp GROUP BY 1),
kp AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM l LEFT JOIN rp ON rp.doc_id = l.doc_id AND rp.p = l.pos WHERE rp.p IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(body, '')) END AS text_md5
FROM documents d LEFT JOIN ra USING (doc_id) LEFT JOIN kp ON kp.doc_id = d.doc_id
"""


def op10(share: float, epochs: int, seed: int, domain_weights: list[tuple], lang_weights: list[tuple]) -> str:
    """The tree is filled level by level with the rule of ``mixing.fill``."""
    listed = {"domain": (domain_weights, "domain, weight"), "lang": (lang_weights, "domain, lang, weight")}
    steps, parent, above = [], "root", "b0"
    for depth, name in enumerate(mixing.LEVELS):
        keys = ", ".join(mixing.LEVELS[: depth + 1])
        rows, names = listed.get(name, ([], ""))
        weight = f"LEFT JOIN (SELECT * FROM {_values(rows, names)}) w USING ({keys})" if rows else "LEFT JOIN (SELECT 1 AS weight WHERE false) w ON true"
        steps.append(f"""
n{depth} AS (SELECT 0 AS root, {keys}, sum(tokens) * {epochs} AS capacity FROM leaves GROUP BY ALL HAVING sum(tokens) > 0),
c{depth} AS (SELECT n.*, p.budget, coalesce(w.weight, 1) AS weight FROM n{depth} n JOIN {above} p USING ({parent}) {weight}),
r{depth} AS (SELECT *, row_number() OVER o AS rn, budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
 FROM c{depth} WINDOW o AS (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / weight, {name})),
f{depth} AS (SELECT *, capacity * ws <= weight * lft AS fl FROM r{depth}),
v{depth} AS (SELECT {parent}, arg_min(lft, rn) AS l, arg_min(ws, rn) AS w FROM f{depth} WHERE NOT fl GROUP BY ALL),
b{depth + 1} AS (SELECT f.root, {', '.join('f.' + k for k in mixing.LEVELS[: depth + 1])}, CASE WHEN fl THEN capacity ELSE weight * l // w END AS budget FROM f{depth} f LEFT JOIN v{depth} v USING ({parent}))""")
        parent, above = f"root, {keys}", f"b{depth + 1}"
    return f"""
WITH d AS (SELECT doc_id, 'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4) AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT 0 AS root, least(floor(sum(tokens) * {share}::DOUBLE), sum(tokens) * {epochs})::HUGEINT AS budget FROM leaves),{','.join(steps)},
pl AS (SELECT domain, lang, source, budget // tokens AS full_epochs, budget % tokens AS rest FROM b{len(mixing.LEVELS)} JOIN leaves USING (domain, lang, source) WHERE budget > 0),
pd AS (SELECT d.*, full_epochs, rest FROM d JOIN pl USING (domain, lang, source)),
wh AS (SELECT doc_id, domain, lang, source, unnest(range(1, CAST(full_epochs AS BIGINT) + 1)) AS epoch, n_tokens, n_tokens AS take_tokens FROM pd),
pt AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(md5('{seed}:' || (full_epochs + 1) || ':' || doc_id), 1, 12), doc_id) - n_tokens AS at_token FROM pd WHERE rest > 0)
SELECT * FROM wh UNION ALL SELECT doc_id, domain, lang, source, full_epochs + 1, n_tokens, least(n_tokens, rest - at_token) FROM pt WHERE at_token < rest
"""

OP12 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
f AS (SELECT *, len('### ' || regexp_replace(regexp_replace(role, '(\\*)(### |: |</turn>)', '\1\1\\\2', 'g'), '(\\+)\z', '\1\1') || ': '
 || regexp_replace(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g'), '(\\+)\z', '\1\1') || '</turn>' || chr(10)) AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role) AS said,
 coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS formatted_chars FROM f GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
 FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
 s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""

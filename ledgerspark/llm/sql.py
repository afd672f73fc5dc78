"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, mixing
from .decontaminate import WINDOW

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP2 = f"""
WITH size AS (SELECT source, coalesce(sum(octet_length(encode(text))), 0)::DOUBLE AS size FROM documents GROUP BY source),
target AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, {mixing.TEMPERATURE}) ELSE 0 END AS target FROM size),
rate AS (SELECT source, target / (SELECT sum(target) FROM target) * (SELECT sum(size) FROM target) / size AS rate FROM target WHERE size > 0),
term AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 12)::BIGINT) + 1)) AS k FROM rate)),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM term),
doc AS (SELECT doc_id, source, text, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, doc.source, text, count(*) AS n FROM doc JOIN cdf ON doc.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY ALL),
copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1))::INTEGER AS copy FROM n)
SELECT doc_id, source, text, copy, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 15))::BIGINT AS mix_order FROM copies
"""

_OP7 = f"""
WITH item AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
item_window AS (SELECT DISTINCT item, k, w[i:i + k - 1] AS win FROM (SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_window AS (SELECT doc_id, k, i, w[i:i + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM item_window) WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, i, item FROM doc_window JOIN item_window USING (k, win)),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, word.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = "length(replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2'))"
_OP10 = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(n))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(13 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""

_TEMPLATES = ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())
_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_OP6 = rf"""
WITH template(license, said) AS (VALUES {_TEMPLATES}),
template_word AS (SELECT license, word, count(*) AS tf FROM (SELECT license, unnest({_TOKENS.format("said")}) AS word FROM template) GROUP BY ALL),
idf AS (SELECT word, ln((1 + {len(licenses.TEMPLATES)}) / (1.0 + count(*))) + 1 AS idf FROM template_word GROUP BY word),
template_weight AS (SELECT license, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license)) AS weight FROM template_word JOIN idf USING (word)),
file AS (SELECT doc_id, text, CASE WHEN regexp_matches(lower(split_part(coalesce(text, ''), chr(10), 1)), '{licenses.CUE}')
    THEN source || '/' || lang || '/LICENSE.' || doc_id ELSE source || '/' || lang || '/' || (doc_id // 1000) || '/' || doc_id || '.txt' END AS path FROM documents),
line AS (SELECT path, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM file),
sentence AS (SELECT DISTINCT path, trim(unnest(string_split(regexp_replace(line, '([.!?])[ \t\r]+', '\1' || chr(1), 'g'), chr(1))), ' ') AS unit FROM line),
unit AS (SELECT DISTINCT unit FROM sentence WHERE regexp_matches(lower(unit), '{licenses.CUE}')),
unit_word AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest({_TOKENS.format("unit")}) AS word FROM unit) GROUP BY ALL),
unit_weight AS (SELECT unit, word, tf * coalesce(idf, ln(1 + {len(licenses.TEMPLATES)}) + 1) AS x FROM unit_word LEFT JOIN idf USING (word)),
length AS (SELECT unit, sqrt(sum(x * x)) AS length FROM unit_weight GROUP BY unit),
score AS (SELECT unit, license, round(sum(x * weight) / any_value(length), 6) AS score FROM unit_weight JOIN template_weight USING (word) JOIN length USING (unit) GROUP BY unit, license),
best AS (SELECT unit, license, score FROM score WHERE score >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, license) = 1),
own AS (SELECT path, license, score FROM sentence JOIN best USING (unit) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
dir AS (SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM file),
given AS (SELECT dir AS holder, license FROM own JOIN dir USING (path) WHERE regexp_matches(path, '/LICENSE[.][^/]*$') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, license) = 1),
nearest AS (SELECT dir, holder, license FROM (SELECT DISTINCT dir FROM dir) JOIN given ON dir = holder OR starts_with(dir, holder || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(holder) DESC) = 1)
SELECT doc_id, file.path, own.license AS own_license, own.score AS own_score, coalesce(own.license, nearest.license) AS license,
  CASE WHEN own.license IS NULL THEN nearest.holder END AS from_dir, own.license IS NULL AND nearest.license IS NOT NULL AS inherited
FROM file JOIN dir USING (path) LEFT JOIN own USING (path) LEFT JOIN nearest USING (dir)
"""

ORACLE = {"op2_mixing": _OP2, "op6_license_scan": _OP6, "op7_decontamination": _OP7, "op10_chat_format": _OP10}

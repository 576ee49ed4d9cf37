"""The operators' queries and their SQL.

`base_opN` are the contract's base columns of opN alone, where SQL can express them.
"""

from __future__ import annotations

from .chat_format import OP7_SQL, op7_chat_format
from .decontaminate import op9_decontaminate
from .html_extract import op3_html_extract
from .license_scan import PHRASES, op1_license_scan
from .lm_scoring import op5_lm_scoring
from .packing import op6_packing
from .pii import op10_pii
from .quality_classifier import op2_quality_classifier
from .quality_rules import op4_quality_rules
from .simhash import op8_simhash

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
#: Words of ASCII letters, digits and all that is not ASCII; words between ASCII white space.
_ALNUM = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')"


def base_op1(spark, sf_dir):
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _phrase_hits() -> str:
    parts = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        test = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(words))
        parts.append(f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(len(w) - {len(words) - 1})) AS i FROM d) WHERE {test}")
    return " UNION ALL ".join(parts)


BASE1_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), h AS ({_phrase_hits()}),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""


def base_op4(spark, sf_dir):
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM t, range(5) AS x(j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def base_op10(spark, sf_dir):
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(reverse({_DIGITS})[i] AS INT) + 1] END)) % 10 = 0"


def _matches(pattern: str, test: str = "true") -> str:
    return f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}'), lambda x: {test}))::BIGINT"


BASE10_SQL = f"""
SELECT doc_id, {_matches("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")} AS n_email,
  {_matches("[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", "list_bool_and(list_transform(string_split(x, '.'), lambda p: try_cast(p AS UHUGEINT) <= 255))")} AS n_ip,
  {_matches("[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")} AS n_card,
  {_matches("[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")} AS n_phone
FROM documents
"""

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
k AS (SELECT item, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS gram FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM k)),
sizes AS (SELECT DISTINCT size FROM i),
g AS (SELECT row, size, s, array_to_string(w[s:s + size - 1], ' ') AS gram FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
f AS (SELECT DISTINCT g.row, g.size, g.s, i.item FROM g JOIN i ON g.size = i.size AND g.gram = i.gram),
hit AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(s, s + size)) AS p FROM f) GROUP BY row),
items AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, item FROM f) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_html_extract": op3_html_extract,
        "op4_quality_rules": op4_quality_rules,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_packing": op6_packing,
        "op7_chat_format": op7_chat_format,
        "op8_simhash": op8_simhash,
        "op9_decontaminate": op9_decontaminate,
        "op10_pii": op10_pii,
        "base_op1": base_op1,
        "base_op4": base_op4,
        "base_op10": base_op10,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; tests/llm compares the rest with brute force."""
    return {"op7_chat_format": OP7_SQL, "op9_decontaminate": OP9_SQL, "base_op1": BASE1_SQL, "base_op4": BASE4_SQL, "base_op10": BASE10_SQL}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from loomdoc.llm.infilling import UNIT
from loomdoc.llm.lexical import TERM
from loomdoc.llm.licenses import BASE, NOTICES
from loomdoc.llm.quality import SYMBOLS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"


def op1() -> str:
    """Notice phrases; identifier tags, whose expressions need the parser, stand in no text of the given tables."""
    padded = {p: f"' {p} '" for p, _, _ in NOTICES}
    starts = " || ".join(
        "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in BASE
    )
    pick = lambda pairs: "coalesce(array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(line, {padded[p]}) THEN '{x}' END" for p, x in pairs) + "], lambda x: x IS NOT NULL))), ','), '')"
    doubt = " * ".join(f"(CASE WHEN contains(line, {padded[p]}) THEN 1 - {w}::DOUBLE ELSE 1 END)" for p, _, w in NOTICES)
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lines AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line, {starts} AS base FROM words)
SELECT doc_id, len(w)::BIGINT AS n_words, len(base)::BIGINT AS n_base, list_min(base)::BIGINT AS first_word, list_max(base)::BIGINT AS last_word,
  {pick(BASE.items())} AS base_labels, {pick([(p, x) for p, x, _ in NOTICES])} AS labels, round(1 - {doubt}, 6) AS score
FROM lines"""


def op5(max_documents: int = 50, min_share: float = 0.3, min_words: int = 20) -> str:
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '\0') AS host, coalesce(text, '') AS t FROM documents
), tokens AS MATERIALIZED (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM tokens, unnest(range(1, len(w) - 6)) AS u(i)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS u(k) GROUP BY r
), norm AS MATERIALIZED (
  SELECT r, host, t, trim(lower(regexp_replace(regexp_replace(line, '[0-9]', '0', 'g'), '{SPACE}+', ' ', 'g'))) AS line
  FROM (SELECT r, unnest(lines) AS line FROM tokens) JOIN docs USING (r)
), frequent AS (
  SELECT host, line FROM norm GROUP BY host, line HAVING count(DISTINCT t) > {max_documents}
), removed AS (
  SELECT r, sum(len(string_split(line, ' '))) AS n FROM norm JOIN frequent USING (host, line) GROUP BY r
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM docs JOIN tokens USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= {min_words} AND n_words - n_removed_words >= {min_share} * n_words AS kept, n_removed_words
FROM judged"""


def op6() -> str:
    """The marked article of the given pages, all of which mark it."""
    return r"""
WITH blocks AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h[1-6]|div|ul|ol|li|table|tr|td|th|section|blockquote|pre)\b[^>]*>') AS b FROM pages
), plain AS (
  SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g'))) AS b FROM blocks
), texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts"""


def op7(seed: int = 42, part: float = 16.0, most: int = 60) -> str:
    u = lambda *x: f"(('0x' || substr(md5(concat_ws(':', {', '.join(x)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    term = "exp(-share + k * ln(share) - lgamma(k + 1))"
    return rf"""
WITH rates AS (
  SELECT source AS s, (SELECT count(*) FROM documents) / (SELECT count(*) FROM (SELECT DISTINCT source FROM documents))::DOUBLE / count(*) AS mean FROM documents GROUP BY source
), shares AS (
  SELECT documents.*, md5(coalesce(text, '')) AS name, greatest(1, ceil(mean / {part}))::INT AS parts, mean / greatest(1, ceil(mean / {part})) AS share
  FROM documents JOIN rates ON documents.source IS NOT DISTINCT FROM rates.s
), drawn AS (
  SELECT *, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(range(0, {most}), lambda m: {u("'" + str(seed) + "'", "coalesce(doc_id::VARCHAR, '')", "name", "j::VARCHAR")} >= list_sum(list_transform(range(0, m + 1), lambda k: {term})))))) AS n FROM shares
), copies AS (SELECT * EXCLUDE (name, parts, share, n), unnest(range(0, n::BIGINT))::INT AS copy, name FROM drawn)
SELECT * EXCLUDE (name), {u("'" + str(seed) + "-order'", "coalesce(doc_id::VARCHAR, '')", "name", "copy::VARCHAR")} AS shuffle_key FROM copies"""


def op11(k: int = 10) -> str:
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return rf"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
docs AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
tf AS MATERIALIZED (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM words) GROUP BY r, t),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
items AS (SELECT row_number() OVER () AS q, item_id, {terms} AS w FROM benchmark),
asked AS (SELECT q, item_id, t, count(*)::BIGINT AS c FROM (SELECT q, item_id, unnest(w) AS t FROM items) GROUP BY ALL),
scores AS (
  SELECT q, item_id, doc_id, sum(c * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN df USING (t) JOIN tf USING (t) JOIN docs USING (r), whole GROUP BY q, item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= {k}"""


def op13(seed: int = 42, percent: int = 50, spm_percent: int = 80) -> str:
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents
), units AS (
  SELECT *, regexp_extract_all(t, '{UNIT}') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(hex, i, 8))::BIGINT) AS h FROM docs
), cut AS (
  SELECT *, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS low, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {percent} THEN 'plain' WHEN h[4] % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS p, coalesce(array_to_string(u[low + 1:high], ''), '') AS m, coalesce(array_to_string(u[high + 1:], ''), '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": op1(), "op5_quality": op5(), "op6_main_text": op6(), "op7_mixing": op7(), "op11_lexical_search": op11(), "op13_fill_in_middle": op13()}

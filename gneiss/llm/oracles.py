"""SQL for DuckDB that gives the rows of those queries which SQL can express."""

from __future__ import annotations

from gneiss.llm import chat, licenses
from gneiss.llm.common import LOWER, RUN, UPPER, WORD

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS v, vec_id AS r FROM v UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.r),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.v = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS n, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - l + 2)) AS k FROM i)),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT doc_id, k, l, item_id FROM dw JOIN win USING (l, g)),
n AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, l)) AS j FROM (SELECT DISTINCT doc_id, k, l FROM hit)) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _licenses() -> str:
    known = ", ".join(f"('{v}', '{k}')" for k, v in licenses.SENTENCES.items())
    found = "seq"
    for licence, rule in licenses.RULES:
        found = f"replace({found}, ' {'  '.join(rule)} ', ' #{licence} ')"
    norm = "array_to_string([trim(x, '.-') for x in string_split(regexp_replace(lower(s), '[^a-z0-9.\\-]+', ' ', 'g'), ' ') if trim(x, '.-') <> ''], ' ')"
    return f"""WITH known(t, id) AS (VALUES {known}),
s AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\\n\\r]+|[.?][ \\t]+') AS p FROM documents)),
m AS (SELECT doc_id, i, coalesce(id, '-') AS id FROM (SELECT doc_id, i, {norm} AS t FROM s WHERE trim(s) <> '') LEFT JOIN known USING (t)),
g AS (SELECT *, id = '-' AND lag(id) OVER (PARTITION BY doc_id ORDER BY i) = '-' AS more FROM m),
q AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (id <> '-') AS n_known, string_agg(id, ' ' ORDER BY i) FILTER (NOT coalesce(more, false)) AS ids, ' ' || string_agg(id, '  ' ORDER BY i) FILTER (NOT coalesce(more, false)) || ' ' AS seq FROM g GROUP BY 1),
f AS (SELECT *, regexp_extract_all({found}, '#(\\S+)', 1) AS found FROM q)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_known, 0) AS n_known, CASE WHEN n_known > 0 THEN ids ELSE '' END AS identifiers,
    CAST(CASE WHEN n_known > 0 THEN len(found) ELSE 0 END AS BIGINT) AS n_rules, CASE WHEN n_known > 0 THEN array_to_string(found, ',') ELSE '' END AS licences
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id"""


def _chat() -> str:
    marks = " ".join(f"WHEN role = '{r}' THEN {len(o) + len(c)}" for r, o, c in chat.TEMPLATE)
    known = ", ".join(f"'{r}'" for r, _, _ in chat.TEMPLATE)
    escapes = lambda c: f"len(regexp_extract_all({c}, '[\\\\\\[<]'))"
    return f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, CASE WHEN role IS NULL THEN {sum(map(len, chat.NONE))} {marks} ELSE {sum(map(len, chat.OTHER))} + length(role) + {escapes("role")} END + length(text)
    + CASE WHEN (role IS NULL OR role IN ({known})) AND NOT regexp_matches(text, '{chat.CONFLICT}') THEN 0 ELSE {escapes("text")} END AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) + {len(chat.BEGIN + chat.END)} AS BIGINT) AS formatted_chars FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


#: Sources in the order of what share of their weight their cap allows: those before the first that stays below it are capped.
MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{RUN}')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS place FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, CAST(([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 3e0 * source_size AS most FROM t),
o AS (SELECT *, row_number() OVER x AS k, sum(most) OVER x - most AS capped, sum(w) OVER () - sum(w) OVER x + w AS rest, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM r WINDOW x AS (ORDER BY most / w, source ROWS UNBOUNDED PRECEDING)),
u AS (SELECT min_by((total - capped) / rest, k) AS unit FROM o WHERE w * ((total - capped) / rest) <= most),
g AS (SELECT source, source_size, least(w * unit, most) AS target FROM r, u),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0e0 END AS whole FROM g),
p AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS need, sum(size) OVER (PARTITION BY d.source ORDER BY place) AS through,
    sum(size) OVER (PARTITION BY d.source, place) AS n, row_number() OVER (PARTITION BY d.source, place) AS i FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN through < need THEN 1 WHEN size > 0 AND through - n < need AND i <= round((need - (through - n)) / size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.r),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY 1), k AS (SELECT a, count(*) AS k FROM link GROUP BY 1)
SELECT doc_id, coalesce(k, 0) AS n_links, component_id, doc_id = component_id AS kept FROM d JOIN c ON c.v = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""

ORACLES = {
    "op1_embedding_dedup": EMBEDDINGS,
    "op2_decontamination": DECONTAMINATION,
    "op3_mixing": MIXING,
    "op5_license_scan": _licenses(),
    "op6_chat_format": _chat(),
    "op9_jaccard_join": JACCARD,
}

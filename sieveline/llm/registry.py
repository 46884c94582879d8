"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from sieveline.llm.ann import op9_ann
from sieveline.llm.bpe import op10_bpe
from sieveline.llm.chat import op4_chat
from sieveline.llm.decontaminate import op8_decontaminate
from sieveline.llm.jaccard import op6_jaccard
from sieveline.llm.langid import op5_langid
from sieveline.llm.secret_scan import op2_secret_scan
from sieveline.llm.substring import op7_substring
from sieveline.llm.surrogates import op3_surrogates
from sieveline.llm.toxicity import op1_toxicity


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_surrogates": op3_surrogates,
    "op4_chat": op4_chat,
    "op5_langid": op5_langid,
    "op6_jaccard": op6_jaccard,
    "op7_substring": op7_substring,
    "op8_decontaminate": op8_decontaminate,
    "op9_ann": op9_ann,
    "op10_bpe": op10_bpe,
}

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4 = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '>', '')) AS re,
    length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS te
  FROM told
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(16 + length(role) + re + length(text) + te) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * common >= 85 * (i.c + j.c - common)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.x = d.doc_id
"""

OP7 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
v AS MATERIALIZED (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM i),
b AS (SELECT doc_id, s FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS place FROM b),
k AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
x AS (SELECT d.doc_id, d.w, coalesce(k.c, 0) AS n_removed, unnest(range(1, len(d.w) + 1)) AS place FROM d LEFT JOIN k USING (doc_id)),
y AS (SELECT x.doc_id, string_agg(x.w[x.place], ' ' ORDER BY x.place) AS kept FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.place = x.place GROUP BY 1)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(k.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN y USING (doc_id)
"""

ORACLES = {"op4_chat": OP4, "op6_jaccard": OP6, "op7_substring": OP7}

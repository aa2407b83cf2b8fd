"""SQL for a second engine (DuckDB) of those queries whose answers SQL can express."""

from __future__ import annotations

#: A-Z lower-cased, and nothing else.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 13 words of items, or all words of a shorter one, found in documents word by word.
CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(13, len(words)) AS n FROM b WHERE len(words) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(words[k : k + n - 1], ' ') AS w FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM sized)),
sizes AS (SELECT DISTINCT n FROM sized),
doc_windows AS (SELECT doc_id, n, k, array_to_string(words[k : k + n - 1], ' ') AS w FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d JOIN sizes ON len(words) >= n)),
hits AS (SELECT doc_id, n, k, item_id FROM doc_windows JOIN item_windows USING (n, w)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: All 50-byte strings with the least document that each starts in; runs of covered bytes; what is left.
REPEATS = """
WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
s AS (SELECT doc_id, i, array_slice(x, i + 1, i + 50) AS w FROM (SELECT doc_id, x, unnest(range(0, octet_length(x) - 49)) AS i FROM h)),
least_doc AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT s.doc_id, i FROM s JOIN least_doc USING (w) WHERE first < s.doc_id),
edges AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM runs),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(CASE WHEN a > z THEN hex(array_slice(x, z + 1, a)) ELSE '' END, '' ORDER BY a) AS kept FROM gaps JOIN h USING (doc_id) GROUP BY doc_id),
rest AS (SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept, '') || CASE WHEN coalesce(last, 0) < octet_length(x) THEN hex(array_slice(x, coalesce(last, 0) + 1, octet_length(x))) ELSE '' END AS kept FROM h LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM rest"""

#: Exact similarity of all documents that share a three-word shingle, and what can be reached over links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

#: Lines of each text, cut at ranks from a digest of the id, and the text put together again from the output's parts.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, x, u, len(u) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, x, u, n, h, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, x, n, form, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
s AS (SELECT *, regexp_split_to_array(output, '<P>|<S>|<M>') AS q FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN q[2] || q[4] || q[3] ELSE q[3] || q[4] || q[2] END) AS restored_sha256 FROM s"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The codebooks of each round as tables: all distances, the nearest entry, floored means."""
    distance = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, x.v, unnest(min({{'d': CAST({distance} AS BIGINT), 'e': y.e}})) FROM x JOIN b{k} y USING (p) GROUP BY x.vec_id, x.label, x.p, x.v)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT p, e, i, sum(s) AS s, count(*) AS c FROM (SELECT p, e, unnest(v) AS s, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY p, e, i)")
            steps.append(f"n{k} AS (SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS v FROM m{k} GROUP BY p, e)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{k}.v, b{k}.v) AS v FROM b{k} LEFT JOIN n{k} USING (p, e))")
    return f"""
WITH z AS (SELECT vec_id, label, list_transform(embedding, lambda q: CAST(floor({scale} * q) AS BIGINT)) AS v, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : p * w + w] AS v FROM (SELECT *, unnest(range(0, {parts})) AS p FROM z)),
b0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM x) WHERE e < {entries}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books"""


ORACLE_SQL: dict[str, str] = {
    "op7_positional_index": CONTAMINATION,
    "op8_cover_suffix_dedup": REPEATS,
    "op10_fast_sketch_dedup": NEAR_DUPLICATES,
    "op11_chunked_fim": FILL_IN_MIDDLE,
    "op12_annular_codes": vector_codes_sql(),
}

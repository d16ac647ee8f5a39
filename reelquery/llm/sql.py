"""SQL for the operators whose whole result SQL can express, over whole tables and whole texts.

Each statement is the plain definition of its operator: every window of every item, every pair of documents that share
a shingle, every pair of vectors. Rows are told apart by their place, so repeated ids count as rows of their own.
"""

from __future__ import annotations

from reelquery.llm.quality import BASE, BULLET, ELLIPSIS, INK, LETTER, RULES, STOP_WORDS, SYMBOL, Rule

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
it AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g FROM starts),
spots AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
seen AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM spots),
hits AS (SELECT rid, item, i, n FROM seen JOIN win USING (n, g)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
who AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN who USING (rid)
"""

# Labels spread along links until they reach the whole component.
_COMPONENTS = "reach(id, r) AS (SELECT DISTINCT a, a FROM link UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r), comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)"

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM spots),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id
"""

OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE CASE WHEN len(p.x) = len(q.x) THEN list_cosine_similarity(p.x, q.x) >= 0.95 END),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY 1),
{_COMPONENTS}
SELECT vec_id, coalesce(deg.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM v LEFT JOIN deg ON deg.a = vec_id LEFT JOIN comp ON comp.id = vec_id
"""


def _failed(r: Rule) -> str:
    per = "1" if r.per == "one" else r.per
    bounds = [f"100 * {r.measure} < {r.at_least} * {per}"] * (r.at_least is not None) + [f"100 * {r.measure} > {r.at_most} * {per}"] * (r.at_most is not None)
    return f"(n_words >= {r.from_words} AND ({' OR '.join(bounds)}))"


def _named(rules: tuple[Rule, ...]) -> str:
    return "[" + ", ".join(f"CASE WHEN {_failed(r)} THEN '{r.name}' END" for r in rules) + "]"


_STOP = ", ".join(f"'{x}'" for s in STOP_WORDS for x in (s, s.capitalize()))

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{INK}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{INK}')) AS l FROM d),
spots AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM p WHERE len(w) >= 8),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(list_slice(w, i, i + 7), ' ')) AS c FROM spots),
rep AS (SELECT rid, count(DISTINCT x) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS x FROM win WHERE c > 1) GROUP BY 1),
m AS (SELECT rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{SYMBOL}')) AS n_symbols, len(list_filter(w, lambda x: regexp_matches(x, '{LETTER}'))) AS n_letter_words,
  len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(l, lambda x: regexp_matches(x, '{BULLET}'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS n_ellipsis_lines FROM p),
v AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (rid)),
f AS (SELECT *, list_filter({_named(BASE)}, lambda x: x IS NOT NULL) AS b, list_filter({_named(RULES)}, lambda x: x IS NOT NULL) AS r FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, len(b) > 0 AS base_failed, len(b) + len(r) = 0 AS kept, n_letter_words, n_stop_words, n_lines, n_bullet_lines, n_ellipsis_lines, array_to_string(list_concat(b, r), ',') AS rules_failed FROM f
"""

# crc32 of a number's decimal text: the table of bytes follows from the polynomial.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))"

OP12 = f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
c AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT c.*, {_CRC.format("click_id")} AS h FROM c, tab),
k AS (SELECT client_id, epoch_us(ts) AS us, kind, CASE WHEN isfinite(value) THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END AS cents, epoch_us(arrived_at) + CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END * 86400000000 < 1709251200000000 AS early FROM h),
known AS (SELECT s.state, k.* FROM k, (VALUES (0), (1)) s(state) WHERE s.state = 1 OR early),
st AS (SELECT state, client_id, min(us) AS t0 FROM known WHERE kind = 'purchase' GROUP BY 1, 2),
mv AS (SELECT a.client_id FROM st a JOIN st b USING (client_id) WHERE a.state = 0 AND b.state = 1 AND a.t0 // 259200000000 <> b.t0 // 259200000000),
crcs AS (SELECT client_id, {_CRC.format("client_id")} AS crc32 FROM (SELECT DISTINCT client_id FROM st), tab),
seg AS (SELECT client_id, city FROM clients QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY updated_at DESC NULLS LAST, city DESC NULLS LAST) = 1),
own AS (SELECT n.state, coalesce(city, '') AS segment, t0 // 259200000000 AS cohort, (us - t0) // 259200000000 AS period, n.client_id, sum(cents) AS cents FROM known n JOIN st USING (state, client_id) LEFT JOIN seg ON seg.client_id = n.client_id WHERE us >= t0 GROUP BY ALL)
SELECT state, segment, cohort, period, count(*) AS users, sum(crc32)::BIGINT AS users_crc32, count(*) FILTER (mv.client_id IS NOT NULL) AS moved, sum(cents)::BIGINT AS cents
FROM own JOIN crcs USING (client_id) LEFT JOIN mv ON mv.client_id = own.client_id GROUP BY 1, 2, 3, 4
"""

"""DuckDB SQL for the operators that SQL can express: plain, exact and without signatures or indexes."""

from __future__ import annotations

from gristmill.llm.license_texts import FILE_NAMES, IDENTIFIERS, TEMPLATES
from gristmill.llm.licenses import CUE, SPDX, TERM, UNKNOWN, terms_of

_SOLID = "'[^\\x20\\x09-\\x0D]+'"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_SOLID}) AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS s FROM (SELECT item_id, regexp_extract_all({_LOWERED}, {_SOLID}) AS w FROM benchmark) x WHERE len(w) > 0),
bg AS (SELECT item_id, n, s, w, unnest(range(0, n - s + 1)) AS o FROM b),
bs AS (SELECT item_id, n, s, o, array_to_string(w[o + 1 : o + s], ' ') AS g FROM bg),
sizes AS (SELECT DISTINCT s FROM b),
dg AS (SELECT doc_id, s, w, unnest(range(0, len(w) - s + 1)) AS p FROM d, sizes WHERE len(w) >= s),
ds AS (SELECT doc_id, s, p, len(w) AS m, array_to_string(w[p + 1 : p + s], ' ') AS g FROM dg),
starts AS (SELECT DISTINCT doc_id, item_id, n, s, unnest(range(greatest(0, p - (n - s)), least(p, greatest(0, m - n)) + 1)) AS st FROM (SELECT DISTINCT ds.doc_id, bs.item_id, bs.n, bs.s, ds.p, ds.m FROM ds JOIN bs USING (s, g)) x),
wc AS (SELECT t.doc_id, t.item_id, t.n, t.s, t.st, ds.g, count(*) AS c FROM starts t JOIN ds ON ds.doc_id = t.doc_id AND ds.s = t.s AND ds.p BETWEEN t.st AND t.st + t.n - t.s GROUP BY ALL),
bc AS (SELECT item_id, g, count(*) AS c FROM bs GROUP BY ALL),
size_of AS (SELECT item_id, sum(c) AS total FROM bc GROUP BY item_id),
f AS (SELECT wc.doc_id, wc.item_id, wc.n, wc.st, sum(wc.c) AS wt, sum(least(wc.c, coalesce(bc.c, 0))) AS shared FROM wc LEFT JOIN bc ON bc.item_id = wc.item_id AND bc.g = wc.g GROUP BY ALL),
r AS (SELECT f.doc_id, f.item_id, f.n, f.st, CAST(shared AS DOUBLE) / CAST(wt + total - shared AS DOUBLE) AS sim FROM f JOIN size_of USING (item_id))
SELECT doc_id, item_id, CAST(st AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words, round(sim, 9) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, st) AS k FROM r WHERE sim >= 0.8) WHERE k = 1
"""

_QUOTED = lambda xs: ", ".join("'" + x + "'" for x in xs)
_LIKE = lambda text: " ".join(terms_of(text))
OP2 = f"""
WITH files AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, row_number() OVER () AS row FROM documents),
tm AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', '{_LIKE(t)}')" for i, (n, t) in enumerate(TEMPLATES))}) AS v(template, name, words)),
tt AS (SELECT template, name, t, count(*) AS c FROM (SELECT template, name, unnest(string_split(words, ' ')) AS t FROM tm) x GROUP BY ALL),
idf AS (SELECT t, ln((SELECT count(*) + 1 FROM tm) / (count(*) + 1)) + 1.0 AS w FROM tt GROUP BY t),
tw AS (SELECT template, name, t, c * w AS x FROM tt JOIN idf USING (t)),
tn AS (SELECT template, sqrt(sum(x * x)) AS norm FROM tw GROUP BY template),
s0 AS (SELECT row, unnest(list_concat(string_split(regexp_replace(text, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), list_filter(string_split(regexp_replace(text, '\n[ \t\r]*\n', chr(0), 'g'), chr(0)), lambda b: contains(b, chr(10))))) AS line FROM files WHERE regexp_matches(lower(text), '{CUE}')),
s1 AS (SELECT row, row_number() OVER () AS id, regexp_extract(line, '{SPDX}', 1) AS named, regexp_extract_all(lower(line), '{TERM}') AS terms FROM s0 WHERE regexp_matches(lower(line), '{CUE}')),
lt AS (SELECT row, id, len(terms) AS size, t, count(*) AS c FROM (SELECT row, id, terms, unnest(terms) AS t FROM s1 WHERE named = '') x GROUP BY ALL),
lw AS (SELECT row, id, size, t, c * coalesce(w, {UNKNOWN}) AS x FROM lt LEFT JOIN idf USING (t)),
ln_ AS (SELECT row, id, size, sqrt(sum(x * x)) AS norm FROM lw GROUP BY ALL),
sc AS (SELECT n.row, n.id, n.size, tw.name, round(sum(lw.x * tw.x) / (n.norm * tn.norm), 9) AS score FROM lw JOIN ln_ n USING (id) JOIN tw ON tw.t = lw.t JOIN tn ON tn.template = tw.template GROUP BY n.row, n.id, n.size, n.norm, tw.template, tw.name, tn.norm),
spelt AS (SELECT * FROM (VALUES {", ".join(f"('{n}')" for n in IDENTIFIERS)}) AS v(identifier)),
all_ AS (SELECT row, name, size, score FROM sc WHERE score >= 0.6 UNION ALL SELECT row, coalesce(identifier, named), len(terms), 1.0 FROM s1 LEFT JOIN spelt ON lower(identifier) = lower(named) WHERE named <> ''),
best AS (SELECT row, name, size, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, name, size DESC) AS k FROM all_) x WHERE k = 1),
own AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/[^/]*$', '') AS dir, b.name, b.score, b.size, len(regexp_extract_all(lower(f.text), '{TERM}')) AS all_terms FROM files f LEFT JOIN best b USING (row)),
grants AS (SELECT dir, name FROM (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) AS k FROM own WHERE name IS NOT NULL AND (2 * size >= all_terms OR regexp_extract(lower(path), '([^/.]*)(\\.[^/]*)?$', 1) IN ({_QUOTED(FILE_NAMES)}))) x WHERE k = 1),
up AS (SELECT DISTINCT dir, unnest([dir, regexp_replace(dir, '/[^/]*$', '')]) AS anc FROM own),
near AS (SELECT dir, anc, name FROM (SELECT up.dir, up.anc, g.name, row_number() OVER (PARTITION BY up.dir ORDER BY length(up.anc) DESC) AS k FROM up JOIN grants g ON g.dir = up.anc) x WHERE k = 1)
SELECT o.doc_id, o.path, o.name AS own_license, o.score, coalesce(o.name, n.name) AS license, CASE WHEN o.name IS NOT NULL THEN o.path ELSE n.anc END AS license_from FROM own o LEFT JOIN near n ON n.dir = o.dir
"""

OP3 = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT row, o, substr(h, 2 * o + 1, 1398) AS piece FROM (SELECT row, h, unnest(range(0, len(h) // 2 - 199, 500)) AS o FROM d WHERE len(h) >= 400) x),
w AS (SELECT row, o + q AS p, md5(substr(piece, 2 * q + 1, 400)) AS k FROM (SELECT row, o, piece, unnest(range(0, len(piece) // 2 - 199)) AS q FROM c) x),
dup AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT row, p, lag(p) OVER (PARTITION BY row ORDER BY p) AS before FROM w WHERE k IN (SELECT k FROM dup)),
n AS (SELECT row, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY p) AS run FROM s),
r AS (SELECT row, run, min(p) AS a, max(p) + 200 AS b FROM n GROUP BY ALL),
g AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS since FROM r),
t AS (SELECT row, h, sum(b - a) AS removed, count(*) AS spans, max(b) AS done, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM g JOIN d USING (row) GROUP BY row, h)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN d.h ELSE kept || substr(d.h, 2 * done + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (row)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SOLID}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS k FROM p),
least_of AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
gone AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS j FROM g JOIN least_of USING (k) WHERE m < g.doc_id),
listed AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i - 1)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN listed USING (doc_id)
"""

OP5 = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all({_LOWERED}, {_SOLID}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM e JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept FROM documents t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

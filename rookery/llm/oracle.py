"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rookery.llm import quality, secrets

_BLANK = r"[\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text,'') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{quality.WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{quality.WORD}')) AS l FROM d),
wins AS (SELECT rid, i, w[i]||' '||w[i+1]||' '||w[i+2] AS s FROM (SELECT rid, w, unnest(range(1, len(w)-1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, s) AS c FROM wins) WHERE c>1),
cov AS (SELECT rid, COUNT(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS j FROM rep) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t)-length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l)-len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n,0) AS BIGINT) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop_words FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars>=2*n_words AND word_chars<=12*n_words AND CAST(n_symbols AS DOUBLE)/greatest(n_words,1)<=0.1 AND CAST(n_stop_words AS DOUBLE)/greatest(n_words,1)>=0.01 AND CAST(n_dup_lines AS DOUBLE)/greatest(n_lines,1)<=0.4 AS kept,
  n_lines, n_stop_words FROM b"""

_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = ((0, "assign", _ASSIGN, 2, 12, 1 << 30), (1, "access", "(AKIA[A-Z0-9]+)", 1, 18, 1 << 30), (2, "hex", "([0-9a-f]+)", 1, 16, 1 << 30), (3, "secret", "([A-Za-z0-9+/]{40,})", 1, 40, 40), (4, "endpoint", "(https?://[A-Za-z0-9.-]+)", 1, 10, 1 << 30))
_FOUND = " UNION ALL ".join(
    f"SELECT rid, {n} AS kind, {lo} AS lo, {hi} AS hi, unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}')))) AS gap, unnest(regexp_extract_all(t, '{p}')) AS whole, unnest(regexp_extract_all(t, '{p}', {g})) AS part, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d"
    for n, _, p, g, lo, hi in _KINDS
)
_BESIDE = f"((p.stop<=w.start AND w.start-p.stop<={secrets.SCOPE}) OR (p.start>=w.stop AND p.start-w.stop<={secrets.SCOPE}))"

OP6 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text,'') AS t FROM documents), f AS MATERIALIZED ({_FOUND}),
e AS (SELECT *, CAST(SUM(length(gap)+length(whole)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM f),
s AS MATERIALIZED (SELECT rid, kind, stop-length(whole) AS start, stop FROM e WHERE length(part) BETWEEN lo AND hi),
a AS (SELECT w.rid, w.kind, w.start, w.stop, arg_min(p.start, 2*(CASE WHEN p.stop<=w.start THEN w.start-p.stop ELSE p.start-w.stop END)+CAST(p.start>w.start AS INT)) AS id FROM s w JOIN s p ON p.rid=w.rid AND p.kind=1 AND w.kind>2 AND {_BESIDE} GROUP BY ALL),
c AS (SELECT * FROM s WHERE kind IN (0,2,3) AND NOT EXISTS (SELECT 1 FROM s p WHERE p.rid=s.rid AND p.kind=1 AND p.start<s.stop AND p.stop>s.start)),
q AS (SELECT rid, kind, start, stop, NULL AS id FROM s WHERE kind<3 UNION ALL SELECT * FROM a w WHERE kind=3 OR EXISTS (SELECT 1 FROM c p WHERE p.rid=w.rid AND {_BESIDE})),
k AS (SELECT *, ['assign','access','hex','secret','endpoint'][kind+1]||':'||start||':'||stop AS txt FROM q),
g AS (SELECT rid, COUNT(*) FILTER (kind=0) AS a, COUNT(*) FILTER (kind=1) AS b, COUNT(*) FILTER (kind=2) AS c, COUNT(*) FILTER (kind=3) AS x, COUNT(*) FILTER (kind=4) AS y, string_agg(txt, ',' ORDER BY start, kind) FILTER (kind<3) AS base, string_agg(txt, ',' ORDER BY start, kind) AS spans, string_agg(start||'>'||id, ',' ORDER BY start, kind) FILTER (kind>2) AS links FROM k GROUP BY 1)
SELECT doc_id, coalesce(a,0) AS n_assign, coalesce(b,0) AS n_access, coalesce(c,0) AS n_hex, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans, coalesce(x,0) AS n_secret, coalesce(y,0) AS n_endpoint, coalesce(links,'') AS links FROM d LEFT JOIN g USING (rid)"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
OP7 = f"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(SUM(length(text)) FILTER (role='assistant'),0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role='assistant'),'')) AS loss_sha256,
  CAST(SUM(length({_ESCAPED.format('role')})+length({_ESCAPED.format('text')})+24) AS BIGINT) AS formatted_chars FROM t GROUP BY 1"""

_WORDS = r"regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, array_to_string(list_slice(w, k, k+least(len(w),10)-1), ' ') AS s, least(len(w),10) AS n FROM (SELECT item_id, w, unnest(range(1, len(w)-least(len(w),10)+2)) AS k FROM b WHERE len(w)>0)),
sizes AS (SELECT DISTINCT n FROM p), x AS (SELECT rid, k, n, array_to_string(list_slice(w, k, k+n-1), ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w)-n+2)) AS k FROM d, sizes)),
o AS (SELECT x.rid, x.k, x.n, p.item_id FROM x JOIN p ON p.s=x.s AND p.n=x.n),
h AS (SELECT rid, COUNT(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(k, k+n)) AS j FROM o) GROUP BY 1), i AS (SELECT rid, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM o) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(ids,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)"""

OP3 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w)<2 THEN w[1] ELSE w[k]||' '||w[k+1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w),2))) AS k FROM d WHERE len(w)>0)),
n AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1), sn AS MATERIALIZED (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id)),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM sn a JOIN sn b ON a.s=b.s AND a.doc_id<b.doc_id AND 100*least(a.n,b.n)>=80*greatest(a.n,b.n) GROUP BY 1,2,a.n,b.n HAVING 100*COUNT(*)>=80*(a.n+b.n-COUNT(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT doc_id AS a, doc_id AS z FROM n UNION SELECT r.a, e.y FROM r JOIN e ON e.x=r.z),
c AS (SELECT a AS doc_id, MIN(z) AS c FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n,0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id=coalesce(c.c, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_CRC32 = "xor(list_reduce(list_transform(range(1, length({s})+1), lambda i: CAST(ascii({s}[i]) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, y: xor(x>>1, 3988292384*(x&1)), xor(c, b)), 4294967295), 4294967295)"
#: Viterbi over rows in order: for each state the least (cost, audit, text), before each row up to two inserted turns.
OP11 = f"""WITH RECURSIVE k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, coalesce(CAST(conv_id AS VARCHAR),' ')||':'||coalesce(CAST(turn AS VARCHAR),' ') AS s FROM conversations),
d AS (SELECT *, {_CRC32.format(s='s')}%20 AS f FROM k), g AS (SELECT conv_id, turn, CASE WHEN f=4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, rtrim(text, {_WHITE}) AS ends FROM o),
r AS MATERIALIZED (SELECT *, CASE WHEN ends='' THEN 1 WHEN nth>1 THEN 2 WHEN right(ends,1) NOT IN ('.','!','?') THEN 3 ELSE 0 END AS fault, substr(role,1,1) AS x FROM p),
stats AS (SELECT conv_id, coalesce(MAX(turn)-MIN(turn)+1-COUNT(DISTINCT turn),0) AS gaps, COUNT(*) FILTER (fault=1) AS blank, COUNT(*) FILTER (fault=2) AS duplicate, COUNT(*) FILTER (fault=3) AS truncated,
  COUNT(*) FILTER (b IS NOT NULL AND x||b NOT IN ('su','ua','au')) AS illegal, COUNT(*) AS n FROM (SELECT *, lead(x) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM r) GROUP BY 1),
nxt(s, t) AS (VALUES (0,2),(1,2),(2,3),(3,2)), ins AS (SELECT s, s AS t, 0 AS c, '' AS a, '' AS say FROM nxt UNION ALL SELECT s, t, 2, 'I', CASE t WHEN 2 THEN chr(10)||'user:' ELSE chr(10)||'assistant:' END FROM nxt
  UNION ALL SELECT y.s, z.t, 4, 'II', CASE z.t WHEN 2 THEN chr(10)||'assistant:'||chr(10)||'user:' ELSE chr(10)||'user:'||chr(10)||'assistant:' END FROM nxt y JOIN nxt z ON z.s=y.t),
v(conv_id, i, s, best) AS (SELECT conv_id, CAST(0 AS BIGINT), 0, {{'c': CAST(0 AS BIGINT), 'a': '', 'say': ''}} FROM stats UNION ALL
  SELECT q.conv_id, q.i, q.s, MIN({{'c': q.c, 'a': q.a, 'say': q.say}}) FROM (
    SELECT v.conv_id, r.i, CASE e.e WHEN 'D' THEN n.t WHEN 'K' THEN CASE r.x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE m.t END AS s, v.best.c+n.c+CASE e.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END+CASE WHEN e.e<>'D' AND r.fault=3 THEN 1 ELSE 0 END AS c, v.best.a||n.a||e.e AS a,
      v.best.say||n.say||CASE e.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10)||r.role||':'||r.text ELSE chr(10)||CASE m.t WHEN 2 THEN 'user:' ELSE 'assistant:' END||r.text END AS say
    FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i=v.i+1 JOIN ins n ON n.s=v.s JOIN nxt m ON m.s=n.t JOIN (VALUES ('D'),('K'),('R')) e(e) ON e.e='D' OR (r.fault NOT IN (1,2) AND (e.e='R' OR (r.x='s' AND n.t=0) OR (r.x='u' AND n.t<>2) OR (r.x='a' AND n.t=2)))) q GROUP BY ALL),
z AS (SELECT v.conv_id, MIN({{'c': v.best.c+n.c, 'a': v.best.a||n.a, 'say': v.best.say||n.say}}) AS best FROM v JOIN stats ON stats.conv_id IS NOT DISTINCT FROM v.conv_id AND v.i=stats.n JOIN ins n ON n.s=v.s AND n.t IN (0,3) GROUP BY 1)
SELECT c.conv_id, CAST(coalesce(gaps,0) AS BIGINT) AS gaps, coalesce(blank,0) AS blank, coalesce(duplicate,0) AS duplicate, coalesce(truncated,0) AS truncated, coalesce(illegal,0) AS illegal, coalesce(z.best.c,0) AS cost, coalesce(z.best.a,'') AS audit, sha256(coalesce(substr(z.best.say,2),'')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""

OP12 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text,''), chr(10)) AS l FROM documents), x AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, {_LOWER.format(f'trim(line, {_WHITE})')} AS k FROM x), r AS (SELECT k, MAX(doc_id) AS top FROM k WHERE length(k)>=40 GROUP BY 1 HAVING COUNT(DISTINCT rid)>=5),
y AS (SELECT k.*, r.k IS NOT NULL AND r.top IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN r ON r.k=k.k)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone),'')) AS kept_sha256 FROM y GROUP BY rid, doc_id"""

_PART = "array_to_string(list_slice(w, {}, {}), ' ')"
OP13 = f"""WITH t AS (SELECT coalesce(lang,'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text,'')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM p GROUP BY 1), c AS MATERIALIZED (SELECT lang, s, k, COUNT(*) AS f FROM (SELECT lang, k, {_PART.format('i', 'i+k-1')} AS s FROM (SELECT lang, w, k, unnest(range(1, len(w)-k+2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w)>=k)) GROUP BY ALL HAVING COUNT(*)>=100),
x AS (SELECT lang, s, k, f AS a, string_split(s, ' ') AS w FROM c WHERE k>1), y AS (SELECT lang, s, a, j, {_PART.format('1', 'j')} AS b, {_PART.format('j+1', 'k')} AS e FROM (SELECT *, unnest(range(1, k)) AS j FROM x)),
z AS (SELECT y.lang, y.s, y.a, n.n, MIN({{'score': CAST(CAST(1000 AS HUGEINT)*y.a*n.n//(CAST(l.f AS HUGEINT)*r.f) AS BIGINT), 'j': y.j, 'l': l.f, 'r': r.f}}) AS m FROM y JOIN n USING (lang) JOIN c l ON l.lang=y.lang AND l.s=y.b JOIN c r ON r.lang=y.lang AND r.s=y.e GROUP BY ALL),
h AS (SELECT z.* FROM z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang=z.lang AND c.k>1 AND length(c.s)>length(z.s) AND 100*c.f>=100*z.a AND contains(' '||c.s||' ', ' '||z.s||' '))),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, s) AS rank, s AS phrase, a, m.l AS l, m.r AS r, n, m.score AS score FROM h) SELECT * FROM o WHERE rank<=2000"""

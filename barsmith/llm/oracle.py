"""DuckDB SQL of the operators on whole trees and conversations: the same results by recursive queries, for small tables."""

from __future__ import annotations

# The unsigned crc32 of an ASCII text, byte by byte and bit by bit.
CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({}, ''), lambda ch: ord(ch)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295)"


def merkle_sql() -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    around = "coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
    return f"""
WITH RECURSIVE p AS (SELECT CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS k, doc_id, {part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} AS head, text,
 doc_id IS NOT NULL AND {CRC.format("coalesce(doc_id, 0)::VARCHAR")} % 5 = 0 AS hit FROM documents),
f AS (SELECT k, doc_id, sha256(head || {part('text')}) AS leaf, CASE WHEN hit THEN sha256(head || {part(low)}) END AS found FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM f),
nd AS (SELECT k, 0 AS lv, pos, leaf AS h, n FROM b UNION ALL SELECT k, lv + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM nd WHERE n > 1 GROUP BY k, lv, pos // 16, n),
sr AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM nd WHERE n = 1),
tn AS (SELECT 0 AS lv, pos, subroot AS h, n FROM sr UNION ALL SELECT lv + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM tn WHERE n > 1 GROUP BY lv, pos // 16, n),
sb AS (SELECT k, lv, pos, {around} FROM nd WHERE n > 1 WINDOW w AS (PARTITION BY k, lv, pos // 16 ORDER BY pos)),
st AS (SELECT lv, pos, {around} FROM tn WHERE n > 1 WINDOW w AS (PARTITION BY lv, pos // 16 ORDER BY pos)),
pa AS (SELECT b.k, b.pos, sb.lv AS step, l, r FROM b JOIN sb ON sb.k = b.k AND sb.pos = b.pos // (16 ** sb.lv)::BIGINT
 UNION ALL SELECT b.k, b.pos, 100 + st.lv, l, r FROM b JOIN sr ON sr.k = b.k JOIN st ON st.pos = sr.pos // (16 ** st.lv)::BIGINT),
pn AS (SELECT *, row_number() OVER (PARTITION BY k, pos ORDER BY step) AS s FROM pa),
fd AS (SELECT k, pos, 0::BIGINT AS s, coalesce(found, leaf) AS h FROM b UNION ALL SELECT x.k, x.pos, x.s + 1, sha256(y.l || x.h || y.r) FROM fd x JOIN pn y ON y.k = x.k AND y.pos = x.pos AND y.s = x.s + 1),
e AS (SELECT k, pos, arg_max(h, s) AS folded_root FROM fd GROUP BY 1, 2), g AS (SELECT k, pos, sha256(string_agg(l || r, '' ORDER BY s)) AS proof FROM pn GROUP BY 1, 2)
SELECT b.doc_id, b.leaf, sr.subroot, t.h AS root, coalesce(g.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM b JOIN sr ON sr.k = b.k JOIN e ON e.k = b.k AND e.pos = b.pos LEFT JOIN g ON g.k = b.k AND g.pos = b.pos CROSS JOIN (SELECT h FROM tn WHERE n = 1) t"""


def repair_sql() -> str:
    way = lambda p, cost, letter, line: f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + {cost}, 'a': {p}.a || '{letter}', 't': {p}.t || {line}}} END"
    nl = "chr(10) || "
    ins = lambda p, role: way(p, 5, "I", f"{nl}'{role}:'")
    two = lambda p: way(p, 10, "II", f"{nl}'user:' || {nl}'assistant:'")
    least = lambda *x: f"list_min([{', '.join(x)}])"
    drop = lambda p: way(p, 2, "D", "''")
    keep = lambda p, x: f"CASE WHEN open AND role[1:1] = '{x}' THEN {way(p, 'more', 'K', nl + 'role || ' + chr(39) + ':' + chr(39) + ' || text')} END"
    put = lambda p, role: f"CASE WHEN open THEN {way(p, '1 + more', 'R', nl + chr(39) + role + ':' + chr(39) + ' || text')} END"
    user = least("p2", ins("p0", "user"), ins("p1", "user"), ins("p3", "user"))
    assistant = least("p3", ins("p2", "assistant"), two("p0"), two("p1"))
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return f"""
WITH RECURSIVE c AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS code FROM conversations),
d AS (SELECT *, {CRC.format("code")} % 20 AS kind FROM c),
m AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) AS nth, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z,
 lag(role) OVER w AS before FROM m WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
r AS (SELECT *, CASE WHEN z = '' THEN 1 WHEN nth > 1 THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
q AS (SELECT *, fault NOT IN (1, 2) AS open, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more FROM r),
dp AS (SELECT DISTINCT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS p0, {none} AS p1, {none} AS p2, {none} AS p3 FROM q
 UNION ALL SELECT k, i, {drop('p0')}, {least(drop('p1'), keep('p0', 's'))}, {least(drop('u'), keep('p0', 'u'), keep('p1', 'u'), keep('a', 'u'), put('p0', 'user'), put('p1', 'user'), put('a', 'user'))},
 {least(drop('a'), keep('u', 'a'), put('u', 'assistant'))}
 FROM (SELECT dp.k, q.i, q.role, q.text, q.open, q.more, p0, p1, p2, p3, {user} AS u, {assistant} AS a FROM dp JOIN q ON q.k = dp.k AND q.i = dp.i + 1)),
w AS (SELECT k, {least('p0', 'p3', ins('p2', 'assistant'), two('p1'))} AS best FROM dp QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
s AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
 count(*) FILTER (i > 1 AND before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY k)
SELECT e.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
 coalesce(w.best.c, 0) AS cost, coalesce(w.best.a, '') AS audit, sha256(coalesce(substring(w.best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN s ON s.k = coalesce(e.conv_id::VARCHAR, ' ') LEFT JOIN w ON w.k = s.k"""

"""SQL for DuckDB of the operators that SQL can express over whole tables; the others are tested against brute force and round trips."""

from __future__ import annotations

# Words are runs of anything but the six white-space bytes.
WORDS = "regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"

# Sets that are similar enough share one of their rarest shingles, a sixth of each set; only those pairs are counted in full.
OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, unnest(range(len(w))) AS i FROM w WHERE len(w) >= 5),
z AS (SELECT doc_id, n, i, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS x FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT doc_id, list(DISTINCT x) AS s FROM z WHERE i <= n - 5 GROUP BY doc_id),
s AS (SELECT w.doc_id, CASE WHEN len(w.w) = 0 THEN [] WHEN len(w.w) < 5 THEN [array_to_string(w.w, ' ')] ELSE y.s END AS s FROM w LEFT JOIN y ON y.doc_id = w.doc_id),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s WHERE len(s) > 0),
k AS (SELECT n, md5(array_to_string(list_sort(s), chr(10))) AS h, min(doc_id) AS rep FROM (SELECT doc_id, s, len(s) AS n FROM s WHERE len(s) > 0) GROUP BY n, h),
m AS (SELECT s.doc_id, k.rep FROM s JOIN k ON k.n = len(s.s) AND k.h = md5(array_to_string(list_sort(s.s), chr(10))) WHERE len(s.s) > 0),
r AS (SELECT e.* FROM e JOIN (SELECT DISTINCT rep FROM m) ON e.doc_id = rep),
q AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY f.c, r.x) AS k FROM r JOIN (SELECT x, count(*) AS c FROM r GROUP BY x) f ON f.x = r.x),
h AS (SELECT * FROM q WHERE k <= n - (85 * n + 99) // 100 + 1),
p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
v AS (SELECT x, y, len(a.s) AS n, len(b.s) AS o, len(list_intersect(a.s, b.s)) AS c FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y),
u AS (SELECT x, y FROM v WHERE 100 * c >= 85 * (n + o - c)), l AS (SELECT x, y FROM u UNION ALL SELECT y, x FROM u),
c AS (SELECT DISTINCT rep AS node, rep AS root FROM m UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.node WHERE c.root < l.y),
g AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(g.root, s.doc_id) AS component_id, s.doc_id = coalesce(g.root, s.doc_id) AS kept
FROM s LEFT JOIN m ON m.doc_id = s.doc_id LEFT JOIN g ON g.node = m.rep"""

OP3 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
b AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM f),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM s GROUP BY doc_id, run),
a AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS runs FROM r GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM r UNION ALL SELECT doc_id, max(hi), NULL FROM r GROUP BY doc_id),
t AS (SELECT d.doc_id, string_agg(substr(d.h, 2 * k.lo + 1, 2 * (coalesce(k.hi, d.n) - k.lo)), '' ORDER BY k.lo) AS h FROM d JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(a.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(a.runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP9 = f"""WITH d AS (SELECT doc_id, {WORDS.format(text="text")} AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM f), g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w[e.i] AS word, e.i FROM d JOIN (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM d) e ON e.doc_id = d.doc_id ANTI JOIN c ON c.doc_id = e.doc_id AND c.i = e.i),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP11 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node WHERE r.root < l.y),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.x = e.vec_id"""

OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS l, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS g FROM d),
c AS (SELECT doc_id, t, l, len(l) AS n, least(g[1] % (len(l) + 1), g[2] % (len(l) + 1)) AS a, greatest(g[1] % (len(l) + 1), g[2] % (len(l) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(l[1:a], ''), '') AS x, coalesce(array_to_string(l[a + 1:b], ''), '') AS y, coalesce(array_to_string(l[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM p"""


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(cost: str, edit: str, after: str) -> str:
    return f"{{'c': {cost} + {after}.c, 'a': '{edit}' || {after}.a}}"


_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_OTHER = (2, 2, 3, 2)
_NONE = "{'c': CAST(1000000 AS BIGINT), 'a': ''}"
_END = "{'c': CAST(0 AS BIGINT), 'a': ''}"


def _closed(name: str, state: int) -> str:
    one = _OTHER[state]
    return _least(f"{name}{state}", _way("3", "I", f"{name}{one}"), _way("6", "II", f"{name}{_OTHER[one]}"))


def _edited(state: int) -> str:
    """The cheapest way on from a state with the row at hand: delete, keep, or give it the role that fits."""
    more = "CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END"
    keep = " ".join(f"WHEN r.fault NOT IN ('blank', 'duplicate') AND r.letter = '{x}' THEN {_way(more, 'K', f'f.x{to}')}" for x, to in _NEXT[state].items())
    rerole = f"CASE WHEN r.fault NOT IN ('blank', 'duplicate') THEN {_way(f'3 + {more}', 'R', f'f.x{_OTHER[state]}')} ELSE {_NONE} END"
    return _least(_way("4", "D", f"f.x{state}"), f"CASE {keep} ELSE {_NONE} END", rerole)


_STATES = range(4)
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)), 4294967295)"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP13 = f"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS kind FROM o),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
q AS (SELECT *, row_number() OVER v AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS letter, right(rtrim(text, {_SPACES}), 1) AS last,
 lag(left(role, 1)) OVER v AS before FROM d WINDOW v AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
r AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM q),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
f AS (SELECT conv_id, n + 1 AS i, {', '.join(f"{_closed('z', s)} AS x{s}" for s in _STATES)} FROM (SELECT conv_id, n, {_END} AS z0, {_NONE} AS z1, {_NONE} AS z2, {_END} AS z3 FROM n)
 UNION ALL SELECT conv_id, i, {', '.join(f"{_closed('z', s)} AS x{s}" for s in _STATES)} FROM (SELECT f.conv_id, r.i, {', '.join(f"{_edited(s)} AS z{s}" for s in _STATES)} FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i - 1)),
a AS (SELECT conv_id, x0.c AS cost, x0.a AS audit FROM f WHERE i = 1),
g AS (SELECT conv_id, 1 AS p, 1 AS i, '' AS state, CAST(NULL AS VARCHAR) AS made FROM a
 UNION ALL SELECT conv_id, p + 1, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN left(role, 1) ELSE left(fit, 1) END,
  CASE WHEN e = 'D' THEN made ELSE coalesce(made || chr(10), '') || CASE e WHEN 'K' THEN role || ':' || text WHEN 'R' THEN fit || ':' || text ELSE fit || ':' END END
  FROM (SELECT g.*, substr(a.audit, CAST(g.p AS INT), 1) AS e, r.role, r.text, CASE WHEN g.state = 'u' THEN 'assistant' ELSE 'user' END AS fit FROM g JOIN a ON a.conv_id = g.conv_id LEFT JOIN r ON r.conv_id = g.conv_id AND r.i = g.i WHERE g.p <= length(a.audit))),
t AS (SELECT g.conv_id, g.made FROM g JOIN a ON a.conv_id = g.conv_id WHERE g.p = length(a.audit) + 1)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
 coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(t.made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id = c.conv_id LEFT JOIN a ON a.conv_id = c.conv_id LEFT JOIN t ON t.conv_id = c.conv_id"""

"""SQL of the queries of conversations, collocations and near copies of vectors."""

from __future__ import annotations


def _after(price: str, edit: str, rest: str) -> str:
    """An edit before what follows; states are strings of 12 digits of cost and an audit, so the least string is the answer."""
    return f"(lpad((substr({rest}, 1, 12)::BIGINT + {price})::VARCHAR, 12, '0') || '{edit}' || substr({rest}, 13))"


_NEVER = "'900000000000'"


def _step(i: int) -> str:
    """The best way on from state i over one row of code c, without an insert before it."""
    to = {0: 2, 1: 2, 2: 3, 3: 2}[i]
    more = "(CASE WHEN c BETWEEN 'A' AND 'Z' THEN 3 ELSE 0 END)"
    kept = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[i]
    keep = " ".join(f"WHEN '{who}' THEN {_after(more, 'K', f'v{after}')}" for who, after in kept)
    return f"least({_after('4', 'D', f'v{i}')}, CASE WHEN c BETWEEN '0' AND '9' THEN {_NEVER} ELSE least(CASE lower(c) {keep} ELSE {_NEVER} END, {_after(f'3 + {more}', 'R', f'v{to}')}) END) AS b{i}"


def _insert(i: int) -> str:
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    return f"least(b{i}, {_after('3', 'I', f'b{to[i]}')}, {_after('3', 'I', _after('3', 'I', f'b{to[to[i]]}'))}) AS v{i}"


_TAIL = r"rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP11 = rf"""
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
k AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
d AS (SELECT k.*, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS act FROM k, tab),
e AS (SELECT conv, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role,
        CASE act WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN act = 3 THEN 2 ELSE 1 END)) AS copy
      FROM d WHERE act <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM e),
f AS (SELECT *, {_TAIL} = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
        right({_TAIL}, 1) NOT IN ('.', '!', '?') AS cut, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS who FROM r),
g AS (SELECT *, CASE WHEN blank THEN translate(who, 'suao', '0123') WHEN again THEN translate(who, 'suao', '4567') WHEN cut THEN upper(who) ELSE who END AS code,
        lag(who) OVER (PARTITION BY conv ORDER BY i) || who AS pair FROM f),
s AS (SELECT conv, string_agg(code, '' ORDER BY i) AS sig, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM g GROUP BY conv),
w AS (SELECT sig, length(sig) AS i, '000000000000' AS v0, '000000000006II' AS v1, '000000000003I' AS v2, '000000000000' AS v3 FROM (SELECT DISTINCT sig FROM s)
      UNION ALL
      SELECT sig, i - 1, {_insert(0)}, {_insert(1)}, {_insert(2)}, {_insert(3)}
      FROM (SELECT sig, i, {_step(0)}, {_step(1)}, {_step(2)}, {_step(3)} FROM (SELECT *, substr(sig, i, 1) AS c FROM w WHERE i > 0))),
a AS (SELECT s.*, substr(v0, 1, 12)::BIGINT AS cost, substr(v0, 13) AS audit FROM s JOIN w ON s.sig = w.sig AND w.i = 0),
l AS (SELECT conv, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS j FROM a WHERE audit <> ''),
m AS (SELECT *, sum((edit <> 'I')::INT) OVER o AS i, sum((edit <> 'D')::INT) OVER o AS place FROM l WINDOW o AS (PARTITION BY conv ORDER BY j)),
n AS (SELECT m.conv, j, place, edit, CASE WHEN edit <> 'I' THEN f.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
        bool_or(place = 1 AND edit = 'K' AND f.who = 's') OVER (PARTITION BY m.conv) AS has_s
      FROM m LEFT JOIN f ON m.conv = f.conv AND m.i = f.i AND m.edit <> 'I' WHERE edit <> 'D'),
h AS (SELECT conv, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - has_s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha FROM n GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM k) LEFT JOIN a USING (conv) LEFT JOIN h USING (conv)
"""

OP13 = """
WITH RECURSIVE
r AS (SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM r WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND list_count(v) = len(v)
        AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.i AS i, b.i AS j, a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.v) = len(b.v) AND a.i <> b.i
      WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
n AS (SELECT i, count(*) AS c FROM p GROUP BY i),
w AS (SELECT i, i AS j FROM n UNION SELECT w.i, p.j FROM w JOIN p ON w.j = p.i),
c AS (SELECT w.i, min(g.vec_id) AS least FROM w JOIN g ON w.j = g.i GROUP BY w.i)
SELECT vec_id, coalesce(n.c, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(vec_id = coalesce(least, vec_id), true) AS kept
FROM r LEFT JOIN n USING (i) LEFT JOIN c USING (i)
"""

OP12 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, k::INTEGER AS k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, phrase, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
m AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
c AS (SELECT lang, phrase, k, f, ws, unnest(range(1, k)) AS cut FROM m),
s AS (SELECT c.lang, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
             JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT DISTINCT lang, array_to_string(ws[first:first + size - 1], ' ') AS phrase, f FROM m,
        (SELECT unnest([1, 2, 3, 4]) AS first) CROSS JOIN (SELECT unnest([2, 3, 4]) AS size) WHERE first + size - 1 <= k AND size < k),
z AS (SELECT b.* FROM b LEFT JOIN (SELECT lang, phrase, max(f) AS most FROM i GROUP BY ALL) USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= 2000
"""

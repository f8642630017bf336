"""SQL equivalents of the queries that SQL can express on whole tables."""

from __future__ import annotations

from adjudica.llm.conversations import INSERTS, NAMES, NEXT, STATES
from adjudica.llm.licenses import BASE, LOWER, NOTICES, UPPER
from adjudica.llm.urls import BASE as RULES
from adjudica.llm.urls import PATTERNS


def licenses_sql(gap: int = 2, least: float = 0.7) -> str:
    rows = []
    for i, t in enumerate(BASE + NOTICES):
        w = t.phrase.split()
        rows += [f"({i}, '{t.label}', {str(t.exact).lower()}, {len(w) - 1}, {k}, '{a}', '{b}')" for k, (a, b) in enumerate(zip(w, w[1:]))]
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t(template, label, exact, pairs, place, a, b) AS (VALUES {', '.join(rows)}),
p AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT doc_id, template, label, exact, pairs, pos - place AS diagonal, place FROM p JOIN t USING (a, b)),
g AS (SELECT DISTINCT doc_id, template, label, exact, pairs, diagonal FROM v),
f AS (SELECT *, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {gap} THEN 0 ELSE 1 END AS far FROM g),
n AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM f),
s AS (SELECT n.doc_id, n.template, n.label, n.exact, greatest(min(n.diagonal), 0) AS first_word, count(DISTINCT v.place) / max(n.pairs)::DOUBLE AS coverage
      FROM n JOIN v ON n.doc_id = v.doc_id AND n.template = v.template AND n.diagonal = v.diagonal GROUP BY n.doc_id, n.template, n.label, n.exact, n.span),
k AS (SELECT * FROM s WHERE CASE WHEN exact THEN coverage = 1 ELSE coverage >= {least} END),
r AS (SELECT doc_id, count(*) FILTER (template < {len(BASE)}) AS n_base, min(first_word) FILTER (template < {len(BASE)}) AS first_word, max(first_word) FILTER (template < {len(BASE)}) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {len(BASE)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM k GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n_base, 0)::BIGINT AS n_base, r.first_word::BIGINT AS first_word, r.last_word::BIGINT AS last_word,
       coalesce(r.base_labels, '') AS base_labels, coalesce(r.labels, '') AS labels, coalesce(r.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)"""


def urls_sql() -> str:
    rules = ", ".join(f"('{r.text}', '{r.text[:r.text.index('/')]}', '{r.text[r.text.index('/'):]}', '{r.verdict}')" for r in RULES)
    patterns = ", ".join(f"('{r.text}', '{r.verdict}')" for r in PATTERNS)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM u),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
rules(rule, rh, rp, rv) AS (VALUES {rules}), patterns(pattern, pv) AS (VALUES {patterns}),
b AS (SELECT page_id, max(row(length(rule), rule, rv)) AS m FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
p AS (SELECT page_id, max(row(length(pattern), pattern, pv)) AS m FROM c JOIN patterns ON contains(host || path, pattern) GROUP BY page_id)
SELECT c.page_id, host, path, b.m[2] AS rule, coalesce(b.m[3], p.m[3], 'allow') AS verdict, p.m[2] AS pattern FROM c LEFT JOIN b USING (page_id) LEFT JOIN p USING (page_id)"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 256) AS BIGINT)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def climb_sql(name: str, depth: int) -> str:
    """CTEs that build the tree of {name}0 (g, p, n, h, ...) level by level: {name}r<j> are the runs of level j, {name}up adds proof and fold to the nodes of level 0.

    `depth` levels suffice for 8 ** depth nodes."""
    out = []
    for j in range(depth):
        out.append(f"{name}r{j} AS (SELECT g, p // 8 AS p, n, string_agg(h, '' ORDER BY p) AS run FROM {name}{j} GROUP BY g, p // 8, n)")
        out.append(f"{name}{j + 1} AS (SELECT g, p, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h FROM {name}r{j})")
    pairs = [f"CASE WHEN r{j}.n > 1 THEN [substr(r{j}.run, 1, 64 * (t.p // {8**j} % 8)), substr(r{j}.run, 64 * (t.p // {8**j} % 8) + 65)] END" for j in range(depth)]
    joins = " ".join(f"JOIN {name}r{j} r{j} ON r{j}.g IS NOT DISTINCT FROM t.g AND r{j}.p = t.p // {8 ** (j + 1)}" for j in range(depth))
    out.append(f"{name}up AS (SELECT t.g, t.p, list_filter([{', '.join(pairs)}], lambda x: x IS NOT NULL) AS proof FROM {name}0 t {joins})")
    return ",\n".join(out)


def crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})))"


def conversations_sql() -> str:
    """The cheapest way to each state after each row, row by row; between rows, the inserts that lead from one state to another."""
    inserts, edits = [f"({q}, {q}, 0, '', []::VARCHAR[])" for q in STATES], []
    for q in STATES:
        for q2 in INSERTS[q]:
            x = "assistant:" if q2 == 3 else "user:"
            inserts.append(f"({q}, {q2}, 3, 'I', ['{x}'])")
            if q in (0, 1):
                inserts.append(f"({q}, 3, 6, 'II', ['user:', 'assistant:'])")
        edits.append(f"({q}, {q}, 4, 'D', NULL)")
        for letter, q2 in NEXT[q].items():
            edits.append(f"({q}, {q2}, 0, 'K', '{letter}')")
            if letter in NAMES:
                edits.append(f"({q}, {q2}, 3, 'R', '{NAMES[letter]}')")
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql(key)} % 20 AS fault FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, trim(text, {space}) AS said FROM x),
m AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS mark,
      lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
ins(q, q1, c, a, s) AS (VALUES {', '.join(inserts)}), edits(q1, q2, c, a, z) AS (VALUES {', '.join(edits)}),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'c': 0, 'a': '', 's': []::VARCHAR[]}} AS b FROM conversations
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.q2, min({{'c': w.b.c + ins.c + e.c + CASE WHEN m.mark = 'truncated' AND e.a <> 'D' THEN 3 ELSE 0 END, 'a': w.b.a || ins.a || e.a,
      's': w.b.s || ins.s || CASE e.a WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [m.role || ':' || m.text] ELSE [e.z || ':' || m.text] END}})
  FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN ins ON ins.q = w.q
  JOIN edits e ON e.q1 = ins.q1 AND (e.a = 'D' OR (coalesce(m.mark, '') NOT IN ('blank', 'duplicate') AND (e.a = 'R' OR e.z = m.role[1]))) GROUP BY w.conv_id, w.i + 1, e.q2),
n AS (SELECT conv_id, max(i) AS i FROM w GROUP BY conv_id),
best AS (SELECT w.conv_id, min({{'c': w.b.c + ins.c, 'a': w.b.a || ins.a, 's': w.b.s || ins.s}}) AS b FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i JOIN ins ON ins.q = w.q WHERE ins.q1 IN (0, 3) GROUP BY w.conv_id),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (mark = 'blank') AS blank, count(*) FILTER (mark = 'duplicate') AS duplicate,
      count(*) FILTER (mark = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.s, chr(10))) AS repaired_sha256, len(b.s) AS n_repaired
FROM best LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM best.conv_id"""


def merkle_sql(depth: int = 9, groups_depth: int = 3) -> str:
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    crc = crc_sql("doc_id::VARCHAR")
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
WITH f AS (SELECT doc_id, lang AS g, {leaf('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} END AS tampered FROM documents),
t0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM f),
{climb_sql('t', depth)},
u0 AS (SELECT 0 AS g, t{depth}.g AS lang, h, row_number() OVER (ORDER BY t{depth}.g NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM t{depth}),
{climb_sql('u', groups_depth)},
a AS (SELECT t0.doc_id, t0.h AS leaf, u0.h AS subroot, u{groups_depth}.h AS root, coalesce(tampered, t0.h) AS start, list_concat(tup.proof, uup.proof) AS proof
      FROM t0 JOIN tup ON t0.g IS NOT DISTINCT FROM tup.g AND t0.p = tup.p JOIN u0 ON u0.lang IS NOT DISTINCT FROM t0.g JOIN uup ON uup.p = u0.p JOIN u{groups_depth} ON true),
b AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_prepend('', list_transform(proof, lambda s: s[1] || s[2])), lambda x, y: x || y), '')) AS proof_sha256,
      list_reduce(list_prepend([start, ''], proof), lambda x, s: [sha256(s[1] || x[1] || s[2]), ''])[1] AS folded_root FROM a)
SELECT *, folded_root = root AS verified FROM b"""


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses_sql(), "op4_top_k": TOP_K, "op7_urls": urls_sql(), "op11_conversations": conversations_sql(), "op12_merkle": merkle_sql()}

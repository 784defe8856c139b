"""DuckDB SQL of the line queries."""

from lonja.plans.matching_sql import DOMAIN, FINAL, SETS, SUPPORT, VERDICT, retrieval
from lonja.plans.oracle import _DICT, _LEVELS, _quantity, _up

_CODES = "list_transform(string_split(replace(base, ' ', ''), ''), lambda c: ascii(c)::BIGINT)"
#: Names as vectors: grams dealt to 128 places, counts at unit length in whole 256ths.
_VECTORS = f"""b0 AS (SELECT base, {_CODES} AS o FROM (SELECT base FROM lines UNION SELECT base FROM rows_)),
  b1 AS (SELECT base, list_transform(range(1, greatest(len(o) - 2, 1) + 1), lambda i: list_reduce(list_prepend(0::BIGINT, o[i:i + 2]), lambda h, c: (h * 31 + c) % 1000003) % 128) AS g FROM b0),
  b2 AS (SELECT base, list_transform(range(0, 128), lambda p: len(list_filter(g, lambda x: x = p))) AS n FROM b1),
  b3 AS (SELECT base, sqrt(greatest(list_sum(list_transform(n, lambda x: x * x)), 1)) AS len, n FROM b2),
  names AS (SELECT base, list_transform(n, lambda x: floor(256 * x / len)) AS v FROM b3), dots AS (SELECT a.base AS fb, b.base AS mb, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS dot FROM names a, names b)"""


def hybrid(k: int, least: int) -> str:
    """CTEs over lines and rows_ that end in q: k candidates of each line, with support, from both lists."""
    return f"""{_VECTORS}, size AS (SELECT ruc, count(*) AS n FROM rows_ GROUP BY ruc),
  e0 AS (SELECT a.ruc, a.code AS fact, b.ruc AS m_ruc, b.code, dot, 'supplier' AS scope FROM lines a JOIN size s ON s.ruc = a.ruc AND n >= {least} JOIN rows_ b ON b.ruc = a.ruc JOIN dots ON fb = a.base AND mb = b.base
    UNION ALL SELECT a.ruc, a.code, b.ruc, b.code, dot, 'global' FROM lines a JOIN rows_ b ON a.ruc NOT IN (SELECT ruc FROM size WHERE n >= {least}) JOIN dots ON fb = a.base AND mb = b.base),
  e1 AS (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY dot DESC, code || chr(31) || m_ruc) AS place FROM e0), {retrieval("lines", "rows_", k)},
  c0 AS (SELECT ruc, fact, m_ruc, code, {_up("dot / 65536", 6)} AS embedding, scope, 'embedding' AS origin FROM e1 WHERE place <= {k} UNION ALL
    SELECT ruc, fact, m_ruc, code, 0, CASE WHEN ruc IN (SELECT ruc FROM rows_) THEN 'supplier' ELSE 'global' END, 'lexical' FROM v WHERE rank <= {k}),
  c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ruc, fact, code ORDER BY origin, embedding DESC, m_ruc) AS rn FROM c0) WHERE rn = 1),
  fs AS (SELECT *, {SETS} FROM lines), ms AS (SELECT *, {SETS} FROM rows_),
  c2 AS ({SUPPORT("c1.ruc, fact, c1.m_ruc, c1.code, c1.embedding, origin, scope", "c1 JOIN fs a ON a.ruc = c1.ruc AND a.code = fact JOIN ms b ON b.ruc = c1.m_ruc AND b.code = c1.code")}),
  c3 AS (SELECT *, {_up("0.55 * support + 0.45 * (embedding + 1) / 2", 6)} AS retrieval, {_up("1 / (1 + exp(3 - 6 * support))", 6)} AS model FROM c2),
  q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY retrieval DESC, support DESC, lexical DESC, embedding DESC, code) AS place FROM c3) WHERE place <= {k})"""


_TWIN = lambda r: f"(split_part({r}, '-', 1)::BIGINT + CASE WHEN split_part({r}, '-', 1)::BIGINT % 2 = 0 THEN 1 ELSE -1 END) || '-' || split_part({r}, '-', 2)"
_KNOWN = f"""moving AS (SELECT *, unit = 'CAJA' AND truth::BIGINT % 3 = 0 AS moved FROM f), invoiced AS (SELECT * REPLACE (CASE WHEN moved THEN {_TWIN("ruc")} ELSE ruc END AS ruc, CASE WHEN moved THEN '0' || truth WHEN unit = 'CAJA' THEN truth ELSE code END AS code) FROM moving),
  rows_ AS (SELECT * FROM m WHERE NOT regexp_full_match(ruc, '[0-9]*0-7')),
  k0 AS (SELECT x.ruc, x.code AS fact, CASE WHEN x.unit <> 'CAJA' AND x.truth::BIGINT % 7 = 0 THEN al.code END AS ac, ex.code AS xc, tw.ruc AS tr, tw.code AS tc FROM invoiced x LEFT JOIN rows_ al ON al.ruc = x.ruc AND al.code = x.truth
    LEFT JOIN rows_ ex ON ex.ruc = x.ruc AND ex.code = x.code LEFT JOIN rows_ tw ON tw.ruc = {_TWIN("x.ruc")} AND tw.code = ltrim(x.code, '0')),
  known AS (SELECT ruc, fact, CASE WHEN coalesce(ac, xc) IS NOT NULL THEN ruc ELSE tr END AS m_ruc, coalesce(ac, xc, tc) AS code, CASE WHEN ac IS NOT NULL THEN 'alias' WHEN xc IS NOT NULL THEN 'exact' ELSE 'exact_equivalent' END AS kind FROM k0 WHERE coalesce(ac, xc, tc) IS NOT NULL),
  lines AS (SELECT i.* FROM invoiced i WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.ruc = i.ruc AND k.fact = i.code))"""
_FIRST = lambda c: f"CASE WHEN r.{c} > 0 THEN r.{c} WHEN i.{c} > 0 THEN i.{c} ELSE 0 END"
_POSITIVE = lambda x: f"CASE WHEN {x} > 0 THEN {x} END"

SQL = {
    "hybrid_candidates": f"WITH {DOMAIN}, lines AS (SELECT * FROM f), rows_ AS (SELECT * FROM m), {hybrid(6, 6)} SELECT ruc, fact, m_ruc, code, origin, scope, embedding, support, retrieval, place AS rank FROM q",
    "match_lines": f"""WITH {DOMAIN}, {_KNOWN}, {hybrid(6, 6)}, {FINAL("q", 3)}, {_DICT}, {_LEVELS},
  w AS (SELECT ruc, fact, m_ruc, code, kind, 1.0 AS score, 1 AS rank FROM known UNION ALL SELECT ruc, fact, m_ruc, code, {VERDICT(0.72)}, score, rank FROM o),
  w1 AS (SELECT w.*, coalesce(f2, f4) AS conversion, i.value, i.billed, r.cost, {_FIRST("factor")} AS factor, {_FIRST("content")} AS content, {_FIRST("weight")} AS weight FROM w JOIN invoiced i ON i.ruc = w.ruc AND i.code = w.fact JOIN rows_ r ON r.ruc = w.m_ruc AND r.code = w.code
    LEFT JOIN l2 ON l2.ruc = split_part(w.m_ruc, '-', 1)::BIGINT AND l2.code = w.code::BIGINT LEFT JOIN l4 ON l4.code = w.code::BIGINT),
  w2 AS (SELECT *, {_quantity("(CASE WHEN billed > 0 AND conversion > 0 THEN billed * conversion END)")} AS q1, {_quantity("(CASE WHEN value > 0 AND cost > 0 THEN value / cost END)")} AS q2 FROM w1),
  w3 AS (SELECT *, CASE WHEN q1 > 0 THEN q1 ELSE q2 END AS quantity, CASE WHEN q1 > 0 THEN 'conversion' WHEN q2 > 0 THEN 'value' ELSE '' END AS origin FROM w2),
  w4 AS (SELECT *, {_quantity("(CASE WHEN factor > 0 THEN quantity * factor END)")} AS units FROM w3)
  SELECT ruc, fact, m_ruc, code, kind, score, rank, quantity, units, {_quantity("(CASE WHEN content > 0 THEN units * content END)")} AS content_total, {_quantity("(CASE WHEN weight > 0 THEN units * weight END)")} AS weight_total, origin FROM w4""",
}
SQL |= {
    "vector_mining": f"""WITH {DOMAIN}, lines AS (SELECT * FROM f), rows_ AS (SELECT * FROM m), {_VECTORS}, p AS (SELECT a.ruc, a.code AS fact, b.code AS negative, {_up("dot / 65536", 6)} AS similarity FROM f a JOIN m b USING (ruc) JOIN dots ON fb = a.base AND mb = b.base WHERE b.code <> a.truth)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY similarity DESC, negative) AS rank FROM p) WHERE rank <= 2""",
    "facts_from_pairs": f"WITH {DOMAIN} SELECT ruc, code AS fact, base, unit, {_up('cost', 6)} AS cost, factor, content, total FROM f WHERE EXISTS (SELECT 1 FROM m WHERE m.ruc = f.ruc AND m.code = f.truth)",
}

"""DuckDB SQL of the matching queries; texts are built from columns there, so attributes need no parser."""

from lonja.plans.oracle import _grams, _jaccard, _overlap, _sim, _up

_G = "(50 * (1 + p_partkey % 20))"
_TEXT = lambda base, n: f"({base}) || CASE WHEN ({n}) > 1 THEN ' FC_' || ({n}) ELSE '' END || ' CONT_' || {_G} || ' TIPO_MASS'"
_RUC = "l_suppkey || '-' || regexp_extract(p_brand, '[0-9]+')"
_MB, _FB = "upper(p_name) || ' ' || p_type", "upper(p_name) || CASE WHEN l_linenumber % 2 = 1 THEN ' ' || p_type ELSE '' END"
_FN = "(p_size + l_linenumber % 2)"
DOMAIN = f"""m AS (SELECT DISTINCT {_RUC} AS ruc, p_partkey::VARCHAR AS code, {_MB} AS base, {_TEXT(_MB, "p_size")} AS text, CASE WHEN p_size % 2 = 0 THEN 'CAJA' ELSE 'UNIDAD' END AS unit,
    p_size::DOUBLE AS factor, {_G}::DOUBLE AS content, p_size * {_G}::DOUBLE AS total, {_G} / 1000 AS weight, p_retailprice AS cost FROM lineitem JOIN part ON l_partkey = p_partkey),
  f AS (SELECT {_RUC} AS ruc, 'F' || p_partkey AS code, {_FB} AS base, {_TEXT(_FB, _FN)} AS text, CASE WHEN l_linenumber % 2 = 0 THEN 'CAJA' ELSE 'UNIDAD' END AS unit,
    {_FN}::DOUBLE AS factor, {_G}::DOUBLE AS content, {_FN} * {_G}::DOUBLE AS total, {_G} / 1000 AS weight, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS cost, l_extendedprice AS value, l_quantity AS billed, p_partkey::VARCHAR AS truth
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE rn = 1)"""
SETS = "list_distinct(string_split(base, ' ')) AS bw, list_distinct(list_append(string_split(base, ' '), 'MASS')) AS w, {g} AS bg, {t} AS g".format(g=_grams("base"), t=_grams("replace(text, '_', ' ')"))
_ALIKE = f"""{_jaccard("a.w", "b.w")} AS jw, {_jaccard("a.bw", "b.bw")} AS jb, {_overlap("a.w", "b.w")} AS ow, {_overlap("a.bw", "b.bw")} AS ob, {_jaccard("a.g", "b.g")} AS jg, {_jaccard("a.bg", "b.bg")} AS jbg,
    (a.unit = b.unit)::INT AS u, {_sim("a.factor", "b.factor", 6.0)} AS fsim, {_sim("a.content", "b.content", 7.0)} AS csim, {_sim("a.total", "b.total", 7.0)} AS tsim, {_sim("a.weight", "b.weight", 7.0)} AS wsim, {_sim("a.cost", "b.cost", 2.5)} AS ksim"""
PAIRS = f"""{DOMAIN}, fs AS (SELECT *, {SETS} FROM f), ms AS (SELECT *, {SETS} FROM m),
  p AS (SELECT a.ruc, a.code AS fact, b.code AS code, a.truth, {_ALIKE} FROM fs a JOIN ms b USING (ruc))"""
_STRUCT = "(0.10 * u + 0.08 * 1.0 + 0.24 * fsim + 0.22 * csim + 0.22 * tsim + 0.08 * wsim + 0.06 * ksim)"
_LEXICAL = _up("0.18 * jw + 0.28 * jb + 0.18 * ow + 0.22 * ob + 0.05 * jg + 0.09 * jbg", 6)


def SUPPORT(columns: str, pairs: str) -> str:
    """lexical, structure and support of pairs of fs rows (a) and ms rows (b)."""
    inner = f"SELECT *, {_LEXICAL} AS lexical, {_up(_STRUCT, 6)} AS structure FROM (SELECT {columns}, {_ALIKE} FROM {pairs})"
    return f"SELECT *, {_up('0.58 * lexical + 0.42 * structure', 6)} AS support FROM ({inner})"


SCORED = f"""{PAIRS}, q AS (SELECT *, {_LEXICAL} AS lexical, {_up(_STRUCT, 6)} AS structure, {_up("2 * jbg - 1", 6)} AS embedding FROM p),
  r AS (SELECT *, {_up("0.58 * lexical + 0.42 * structure", 6)} AS support FROM q), t AS (SELECT *, {_up("0.55 * support + 0.45 * (embedding + 1) / 2", 6)} AS retrieval, {_up("1 / (1 + exp(3 - 6 * support))", 6)} AS model FROM r),
  v AS (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY retrieval DESC, support DESC, lexical DESC, embedding DESC, code) AS retrieved FROM t)"""
_CLIP = lambda x, low=0: f"least(greatest({x}, {low}), 1)"
def FINAL(found: str, top: int = 5) -> str:
    """Final scores of candidates `found`, as CTEs that end in o: the `top` of each line."""
    return f"""x AS (SELECT *, max(model) OVER w AS high, min(model) OVER w AS low, CASE WHEN support >= 0.72 THEN greatest((embedding + 1) / 2, 0.55) ELSE (embedding + 1) / 2 END AS emb,
    CASE WHEN support >= 0.72 AND lexical >= 0.55 AND fsim >= 0.98 AND csim >= 0.98 AND tsim >= 0.98 THEN 0.05 ELSE 0 END AS bonus FROM {found} WINDOW w AS (PARTITION BY ruc, fact)),
  y AS (SELECT *, CASE WHEN high < 0.15 OR high - low < 0.03 THEN 0.52 * support + 0.25 * lexical + 0.11 * structure + 0.08 * emb + bonus
    ELSE (0.20 * model * ({_CLIP("(lexical - 0.03) / 0.30")} * {_CLIP("(support - 0.12) / 0.40")}) + 0.35 * support + 0.16 * lexical + 0.12 * structure + 0.17 * emb + bonus) * {_CLIP("0.15 + 0.85 * (0.55 * lexical + 0.45 * structure)", 0.15)} END AS raw FROM x),
  z AS (SELECT *, {_up("CASE WHEN lexical < 0.08 AND support < 0.28 THEN least(raw, 0.04 + 0.28 * support + 0.06 * emb + 0.04 * structure) ELSE raw END", 6)} AS score FROM y),
  k AS (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY score DESC, support DESC, lexical DESC, structure DESC, model DESC, embedding DESC, code) AS rank FROM z),
  o AS (SELECT *, {_up("score - coalesce(max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY ruc, fact), 0)", 6)} AS margin FROM k WHERE rank <= {top})"""


VERDICT = lambda t: f"CASE WHEN rank > 1 THEN 'alternative' WHEN score >= {t} AND support >= 0.30 AND (margin >= 0.03 OR support >= 0.55) AND NOT (lexical < 0.12 AND structure < 0.35) THEN 'tentative' ELSE 'maybe_new' END AS verdict"
_LOG = lambda x: f"round(ln(1 + greatest({x}, 0)), 6)"

_REL = lambda c: f"CASE WHEN a.{c} > 0 AND b.{c} > 0 THEN abs(a.{c} - b.{c}) / greatest(a.{c}, b.{c}) ELSE 1.0 END"
_BEST = "list_distinct(string_split({0}.base, ' '))"
_CLEAN = f"list_distinct(list_concat(string_split({{0}}.base, ' '), [({{0}}.content::BIGINT)::VARCHAR, 'GR', 'X', ({{0}}.factor::BIGINT)::VARCHAR]))"
_NEAR = lambda c, most: f"({c}d <= {most})"
def retrieval(f: str, m: str, top: int) -> str:
    """The chain of shortlist, gates and ranks over lines `f` and catalogue `m`, as CTEs that end in v; `top` rows are wanted."""
    return f"""p AS (SELECT a.ruc, b.ruc AS m_ruc, a.code AS fact, b.code AS code, {_jaccard(_BEST.format("a"), _BEST.format("b"))} AS jb, {_jaccard(_CLEAN.format("a"), _CLEAN.format("b"))} AS jc, list_intersect({_BEST.format("a")}, {_BEST.format("b")}) AS met,
    string_split(a.base, ' ')[1:2] = string_split(b.base, ' ')[1:2] AS start, (a.unit = b.unit)::INT AS u, exp(-2.2 * abs(ln(1 + a.cost) - ln(1 + b.cost))) AS ks, {_REL("factor")} AS fd, {_REL("content")} AS cd, {_REL("total")} AS td, {_REL("weight")} AS wd,
    {_sim("a.factor", "b.factor", 7.0)} AS fsim, {_sim("a.content", "b.content", 8.0)} AS csim, {_sim("a.total", "b.total", 8.0)} AS tsim, {_sim("a.weight", "b.weight", 8.0)} AS wsim FROM {f} a JOIN {m} b ON b.ruc = a.ruc OR (a.ruc NOT IN (SELECT ruc FROM {m}) AND list_has_any(string_split(a.base, ' '), string_split(b.base, ' ')))),
  h AS (SELECT *, {_up("least(greatest(0.34 * jb + 0.14 * jc + 0.14 * least(len(met) / 4, 1.0) + 0.08 * start::INT + 0.03 * u + 0.03 * ks + least(0.04 * list_contains(met, 'HOT')::INT + 0.08 * list_contains(met, 'GEAR')::INT, 0.16), 0), 1)", 6)} AS heuristic FROM p),
  l AS (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY heuristic DESC, code, m_ruc) AS listed FROM h),
  g AS (SELECT *, start OR len(met) >= 2 AS family_strict, start OR len(met) >= 1 OR heuristic >= 0.55 AS family_soft, CASE WHEN fd <= 0.02 AND least(cd, td, wd) <= 0.08 THEN 0 WHEN least(cd, td, wd) <= 0.15 THEN 1 WHEN fd <= 0.10 THEN 2 ELSE 3 END AS tier,
    {_up("least(greatest(0.20 + 0.22 * fsim + 0.20 * csim + 0.23 * tsim + 0.15 * wsim, 0), 1)", 6)} AS presentation FROM l WHERE listed <= {max(12 * top, 120)}),
  s AS (SELECT *, sum(family_strict::INT) OVER w >= {max(top, 5)} AS many_strict, sum(family_soft::INT) OVER w >= {max(top, 5)} AS many_soft FROM g WINDOW w AS (PARTITION BY ruc, fact)),
  t AS (SELECT *, family_soft AND {_NEAR("f", 0.02)} AND ({_NEAR("c", 0.08)} OR {_NEAR("t", 0.08)} OR {_NEAR("w", 0.08)}) AS presented_strict, family_soft AND ({_NEAR("f", 0.02)} OR tier <= 1) AS presented_soft,
    {_up("(0.78 * heuristic + 0.22 * presentation) * (0.20 + 0.80 * least(greatest((heuristic - 0.12) / 0.35, 0), 1))", 6)} AS score FROM s WHERE CASE WHEN many_strict THEN family_strict WHEN many_soft THEN family_soft ELSE true END),
  u AS (SELECT *, sum(presented_strict::INT) OVER w >= {top} AS p_strict, sum(presented_soft::INT) OVER w >= {top} AS p_soft FROM t WINDOW w AS (PARTITION BY ruc, fact)),
  v AS (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY family_strict DESC, family_soft DESC, tier, presented_strict DESC, score DESC, heuristic DESC, code, m_ruc) AS rank FROM u WHERE CASE WHEN p_strict THEN presented_strict WHEN p_soft THEN presented_soft ELSE true END)"""

SQL = {
    "candidate_retrieval": f"WITH {DOMAIN}, {retrieval('f', 'm', 3)} SELECT ruc, fact, code, rank, heuristic, presentation, tier, score, family_strict, family_soft, presented_strict, presented_soft FROM v WHERE rank <= 3",
    "prepared_master": f"WITH {DOMAIN} SELECT ruc, code, base, text AS model_text, unit, 'MASS' AS kind, factor, content, total, weight, weight * factor AS weight_total, {_LOG('total')} AS total_log, {_LOG('cost')} AS cost_log FROM m",
    "prepared_invoices": f"WITH {DOMAIN} SELECT ruc, code, base, text AS model_text, unit, 'MASS' AS kind, factor, content, total, weight, weight * factor AS weight_total, cost, {_LOG('cost')} AS cost_log FROM f",
    "support_scores": f"WITH {SCORED} SELECT ruc, fact, code, lexical, structure, support, retrieval, retrieved FROM v WHERE retrieved <= 5",
    "final_scores": f"WITH {SCORED}, {FINAL('(SELECT * FROM v WHERE retrieved <= 80)')} SELECT ruc, fact, code, score, rank, margin, {VERDICT(0.72)} FROM o",
    "match_decision": f"WITH {SCORED}, {FINAL('(SELECT * FROM v WHERE retrieved <= 80)')} SELECT ruc, fact, code, score, margin, {VERDICT(0.60)}, code = truth AS \"right\" FROM o WHERE rank = 1",
    "hard_negatives": f"""WITH {PAIRS}, q AS (SELECT *, {_up(f"0.58 * (0.30 * jw + 0.30 * jb + 0.20 * ow + 0.20 * ob) + 0.42 * {_STRUCT}", 6)} AS support, {_up("2 * jbg - 1", 6)} AS embedding FROM p WHERE code <> truth),
        r AS (SELECT *, {_up("1 / (1 + exp(3 - 6 * support))", 6)} AS model FROM q), s AS (SELECT *, {_up("0.72 * model + 0.18 * support + 0.10 * (embedding + 1) / 2", 6)} AS hardness FROM r WHERE model >= 0.25 OR support >= 0.08)
        SELECT * FROM (SELECT ruc, fact, code AS negative, support, hardness, row_number() OVER (PARTITION BY ruc, fact ORDER BY hardness DESC, model DESC, support DESC, embedding DESC, code) AS rank FROM s) WHERE rank <= 2""",
}

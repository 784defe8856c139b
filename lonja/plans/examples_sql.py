"""DuckDB SQL of the classifier's examples."""

from lonja.operators.training import NO_CATEGORY
from lonja.plans.matching_sql import DOMAIN
from lonja.plans.oracle import _up

_LN = lambda x: _up(f"ln(1 + {x})", 6)
_TERMS = f"list_filter(string_split(base, ' '), lambda t: length(t) > 2 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({', '.join(repr(w) for w in NO_CATEGORY)}))"
_EXAMPLES = f"""{DOMAIN}, mm AS (SELECT m.*, trim(regexp_replace(upper(p_brand), '[^A-Z0-9]+', ' ', 'g')) AS brand, trim(regexp_replace(upper(p_type), '[^A-Z0-9]+', ' ', 'g')) AS category FROM m JOIN part ON p_partkey::VARCHAR = m.code),
  x AS (SELECT * REPLACE (CASE WHEN unit = 'CAJA' THEN truth ELSE code END AS code) FROM f),
  h AS (SELECT 'history' AS source, 1.0 AS weight_base, x.ruc, x.code, x.text, x.base, x.unit, x.factor, x.content, x.total, x.weight, x.cost, mm.factor AS t_factor, mm.weight AS t_weight, mm.brand, mm.category FROM x JOIN mm ON mm.ruc = x.ruc AND (x.code = mm.code OR x.code = '0' || mm.code)),
  e AS (SELECT * FROM h UNION ALL SELECT 'master', 0.25, ruc, code, text, base, unit, factor, content, total, weight, cost, factor, weight, brand, category FROM mm)"""
SQL = {
    "classifier_dataset": f"""WITH {_EXAMPLES} SELECT source, weight_base, ruc, code, text, base, unit, 'MASS' AS kind, weight, {_LN('cost')} AS cost, {_LN('factor')} AS factor, {_LN('content')} AS content, {_LN('total')} AS total, {_LN('t_factor')} AS target_factor_sale_log,
      {_LN('(t_weight * t_factor)')} AS target_weight_case_log, t_factor AS target_factor_case, t_weight AS target_weight, brand, category, 1.0 AS mask_factor_sale, 1.0 AS mask_weight_case, 1.0 AS mask_brand, 1.0 AS mask_category FROM e""",
    "example_features": f"""WITH {_EXAMPLES}, r0 AS (SELECT *, source || '|' || ruc || '|' || code || '|' || text AS id, {_TERMS} AS w, base || ' ' || content::BIGINT || ' GR X ' || factor::BIGINT AS clean FROM e),
      r AS (SELECT *, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM r0), g AS (SELECT id, category, unnest(terms) AS term FROM r), s AS (SELECT category, term, count(*) AS n, count(DISTINCT id) AS d FROM g GROUP BY ALL),
      t AS (SELECT *, n / sum(d) OVER (PARTITION BY term) AS ratio FROM s),
      lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(ratio * ln(1 + n), 6) DESC, length(term) DESC, term) AS rank FROM t WHERE n >= 4 AND ratio >= 0.55) WHERE rank <= 10),
      c AS (SELECT id, lex.category, count(*) AS hits, max(len(string_split(lex.term, ' '))) AS longest FROM (SELECT DISTINCT id, term FROM g) q JOIN lex USING (term) GROUP BY ALL), c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, longest DESC, category) AS rn FROM c) WHERE rn = 1),
      b AS (SELECT base, first(w ORDER BY length(w) DESC, w) AS brand FROM (SELECT DISTINCT base, unnest(string_split(base, ' ')) AS w FROM e) WHERE w IN (SELECT p_type FROM part) GROUP BY base)
      SELECT source, ruc, code, text, coalesce(b.brand, '') AS brand_hint, coalesce(c1.category, '') AS category_hint, (b.brand IS NOT NULL)::INT::DOUBLE AS brand_hint_present, (c1.category IS NOT NULL)::INT::DOUBLE AS category_hint_present, len(string_split(clean, ' '))::DOUBLE AS n_tokens, length(clean)::DOUBLE AS n_chars,
      1.0 AS has_digits, 0.0 AS has_pack_hint, 1.0 AS has_measure_hint, 0.0 AS pack_count_hint, content AS measure_value_hint FROM r LEFT JOIN c1 ON c1.id = r.id LEFT JOIN b ON b.base = r.base""",
}

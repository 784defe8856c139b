"""DuckDB SQL of the training queries."""

from lonja.operators.training import NO_CATEGORY
from lonja.plans.matching_sql import DOMAIN
from lonja.plans.oracle import _jaccard, _up

_L = lambda x: f"ln(1 + {x})"
_W = lambda s: f"list_distinct(string_split(replace({s}, '_', ' '), ' '))"
_GAPS = ", ".join(f"abs({_L('a.' + c)} - {_L('b.' + c)}) AS {c[0]}gap" for c in ("factor", "total", "cost")) + f", abs({_L('a.content')} - {_L('b.content')}) AS ngap"
_PAIR = f"""{DOMAIN}, p AS (SELECT a.ruc, a.code AS fact, b.code AS code, a.truth, {_jaccard(_W("a.text"), _W("b.text"))} AS jt, {_jaccard(_W("a.base"), _W("b.base"))} AS jb, (a.unit = b.unit)::INT AS u, abs(a.weight - b.weight) AS wgap,
    abs(a.weight - b.weight) / greatest(a.weight, b.weight, 1e-6) AS wrel, a.base = b.base AS same, {_GAPS} FROM f a JOIN m b USING (ruc))"""
_NUM = lambda c: f"regexp_extract({c}, '[0-9]+')::BIGINT"
_WORDS = lambda t: f"list_filter(string_split(trim(regexp_replace(upper(strip_accents({t})), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 2 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({', '.join(repr(w) for w in NO_CATEGORY)}))"
_LEXICON = f"""r0 AS (SELECT 'part' AS "of", p_partkey AS id, p_type AS category, {_WORDS("concat_ws(' ', p_name, p_type, p_brand)")} AS w FROM part UNION ALL SELECT 'document', doc_id, lang, {_WORDS("coalesce(text, '')")} FROM documents),
  rows_ AS (SELECT "of", id, category, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM r0),
  e AS (SELECT "of", id, category, unnest(terms) AS term FROM rows_ WHERE category IS NOT NULL), s AS (SELECT "of", category, term, count(*) AS n, count(DISTINCT id) AS r FROM e GROUP BY ALL),
  t AS (SELECT *, n / sum(r) OVER (PARTITION BY "of", term) AS ratio FROM s),
  lex AS (SELECT * FROM (SELECT "of", category, term, n, round(ratio, 6) AS precision, round(ratio * ln(1 + n), 6) AS score, row_number() OVER (PARTITION BY "of", category ORDER BY round(ratio * ln(1 + n), 6) DESC, length(term) DESC, term) AS rank FROM t WHERE n >= 4 AND ratio >= 0.55) WHERE rank <= 10)"""

SQL = {
    "training_pairs": f"""WITH {DOMAIN}, x AS (SELECT ruc, CASE WHEN unit = 'CAJA' THEN truth ELSE code END AS code, truth FROM f), o AS (SELECT ruc, code AS fact, ruc AS master_ruc, code AS master, 0 AS o FROM x JOIN m USING (ruc, code)),
        t AS (SELECT DISTINCT CASE WHEN split_part(ruc, '-', 1)::BIGINT % 3 <> 0 THEN ruc END AS told, code AS fact, truth AS master FROM x WHERE code LIKE 'F%'),
        g AS (SELECT DISTINCT x.ruc, t.fact, told, master FROM t JOIN x ON x.code = t.fact AND (told IS NULL OR told = x.ruc)), one AS (SELECT code, min(ruc) AS r FROM m GROUP BY code HAVING count(DISTINCT ruc) = 1),
        h AS (SELECT g.ruc, fact, coalesce(a.ruc, b.ruc, one.r) AS master_ruc, master, 1 AS o FROM g LEFT JOIN m a ON a.ruc = told AND a.code = master LEFT JOIN m b ON b.ruc = g.ruc AND b.code = master LEFT JOIN one ON one.code = master)
        SELECT ruc, fact, master_ruc, master, CASE WHEN min(o) = 0 THEN 'code' ELSE 'auto_match' END AS source FROM (SELECT * FROM o UNION ALL SELECT * FROM h WHERE master_ruc IS NOT NULL) GROUP BY ruc, fact, master_ruc, master""",
    "negative_samples": f"""WITH {_PAIR}, q AS (SELECT *, {_up("jt", 6)} AS st, {_up("jb", 6)} AS sb, exp(-1.4 * cgap) AS sc, {_up("0.35 * exp(-2.8 * fgap) + 0.25 * exp(-2.8 * ngap) + 0.25 * exp(-2.2 * tgap) + 0.15 * exp(-2.0 * wgap)", 6)} AS close,
          (17 + {_NUM("fact")} * 7919 + {_NUM("code")} * 104729 + {_NUM("ruc")} * 31) % 1000003 AS h FROM p WHERE code <> truth),
        r AS (SELECT *, (h + 0.5) / 1000003 AS r01, least(greatest(sb - st, 0), 1) AS tn FROM q),
        s AS (SELECT *, {_up("0.28 * st + 0.22 * sb + 0.24 * close + 0.08 + 0.05 * u + 0.05 * sc + 0.08 * tn", 6)} AS hardness, {_up("0.34 * sb + 0.28 * close + 0.12 + 0.08 * u + 0.18 * tn", 6)} AS hardness_subtype, {_up("0.45 * st + 0.25 * sb + 0.20 * close + 0.10 * sc", 6)} AS easiness,
          sb >= 0.50 AND close >= 0.78 AS strict, sb >= 0.40 AND close >= 0.70 AS soft FROM r),
        t AS (SELECT *, CASE WHEN bool_or(strict) OVER w THEN strict WHEN bool_or(soft) OVER w THEN soft ELSE true END AS sib, row_number() OVER (PARTITION BY ruc, fact ORDER BY hardness DESC, code) AS g FROM s WINDOW w AS (PARTITION BY ruc, fact)),
        v AS (SELECT *, g <= 24 OR (sib AND row_number() OVER (PARTITION BY ruc, fact, sib ORDER BY hardness_subtype DESC, code) <= 16) AS top FROM t),
        w AS (SELECT *, CASE WHEN top THEN row_number() OVER (PARTITION BY ruc, fact, top ORDER BY {_up("-ln(r01) / greatest(hardness_subtype, 1e-6)", 9)}, code) END AS drawn FROM v),
        y AS (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY easiness DESC, code) AS e FROM w WHERE drawn IS NULL OR drawn > 3),
        z AS (SELECT *, row_number() OVER (PARTITION BY ruc, fact ORDER BY {_up("-ln(r01) / greatest(easiness, 1e-6)", 9)}, code) AS pick FROM y WHERE e <= 8)
        SELECT ruc, fact, code AS negative, 'hard' AS level, hardness, hardness_subtype, easiness FROM w WHERE drawn <= 3 UNION ALL SELECT ruc, fact, code, 'easy', hardness, hardness_subtype, easiness FROM z WHERE pick <= 1""",
    "sample_weights": f"""WITH {_PAIR}, n AS (SELECT greatest(sum((code = truth)::INT), 1) AS pos, greatest(sum((code <> truth)::INT), 1) AS neg FROM p),
        q AS (SELECT *, 0.18 * exp(-1.2 * cgap) + 0.18 * exp(-2.0 * fgap) + 0.16 * exp(-2.0 * ngap) + 0.26 * exp(-2.2 * tgap) + 0.12 * exp(-4.0 * wrel) + 0.10 AS hard, 0.30 * (fgap > 0.10)::INT + 0.20 * (ngap > 0.12)::INT + 0.30 * (tgap > 0.12)::INT AS conflict, CASE WHEN same THEN 1.6 ELSE 1.0 END AS more FROM p)
        SELECT ruc, fact, code, (code = truth)::INT AS label, {_up("least(greatest(CASE WHEN code = truth THEN neg / pos ELSE 1.0 + 2.4 * hard * more + 1.6 * conflict * more END, 1.0), 6.0)", 6)} AS weight FROM q, n""",
    "pair_features": f"""WITH {DOMAIN}, k AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS brand FROM part), b AS (SELECT base, list(brand) AS brands, first(brand ORDER BY length(brand) DESC, brand) AS brand
          FROM (SELECT DISTINCT base, unnest(string_split(base, ' ')) AS w FROM (SELECT base FROM f UNION SELECT base FROM m)) JOIN k ON k.brand = w GROUP BY base),
        p AS (SELECT a.ruc, a.code AS fact, b.code AS code, x.brand AS xb, y.brand AS yb, coalesce(x.brands, []) AS xs, coalesce(y.brands, []) AS ys, a.unit = b.unit AS u, {", ".join(f"least(1 + a.{c}, 1 + b.{c}) / greatest(1 + a.{c}, 1 + b.{c}) AS {c}_q" for c in ("factor", "content", "total", "cost"))}, exp(-abs(a.weight - b.weight)) AS wq
          FROM f a JOIN m b USING (ruc) LEFT JOIN b x ON x.base = a.base LEFT JOIN b y ON y.base = b.base)
        SELECT ruc, fact, code, (xb IS NOT NULL AND yb IS NOT NULL AND xb = yb)::INT::DOUBLE AS same_brand, (xb IS NOT NULL AND yb IS NOT NULL AND xb <> yb)::INT::DOUBLE AS brand_conflict, {_up(_jaccard("xs", "ys"), 6)} AS brand_overlap, u::INT::DOUBLE AS unit_equal, 1.0 AS kind_equal_known,
        {", ".join(f"{_up(f'{c}_q', 6)} AS {c}_sim" for c in ("factor", "content", "total", "cost"))}, {_up("wq", 6)} AS weight_sim FROM p""",
    "category_lexicon": f'WITH {_LEXICON} SELECT category, term, n, precision, score, rank, "of" FROM lex',
    "lexicon_classify": f"""WITH {_LEXICON}, g AS (SELECT "of", id, unnest(list_distinct(terms)) AS term FROM rows_), h AS (SELECT g."of", id, lex.category, count(*) AS hits, max(len(string_split(term, ' '))) AS longest FROM g JOIN lex USING ("of", term) GROUP BY ALL),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "of", id ORDER BY hits DESC, longest DESC, category) AS rn FROM h) WHERE rn = 1) SELECT r."of", r.id, b.category, hits, longest FROM rows_ r LEFT JOIN b ON b."of" = r."of" AND b.id = r.id""",
    "classification_metrics": """WITH e AS (SELECT label AS t, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS p FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        c AS (SELECT c, (SELECT count(*) FROM e WHERE t = c AND p = c) AS tp, (SELECT count(*) FROM e WHERE t = c) AS t, (SELECT count(*) FROM e WHERE p = c) AS p FROM (SELECT DISTINCT t AS c FROM e UNION SELECT DISTINCT p FROM e)),
        r AS (SELECT CASE WHEN p_size > 0 THEN p_retailprice END AS t, avg(p_retailprice) OVER (PARTITION BY p_type) AS p FROM part)
        SELECT * FROM (SELECT sum(t)::BIGINT AS n, round(sum(tp) / sum(t), 6) AS accuracy, round(avg(2 * tp / (t + p)), 6) AS macro_f1 FROM c), (SELECT count(t) AS n_numbers, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) ** 2)), 6) AS rmse FROM r)""",
}

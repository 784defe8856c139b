"""DuckDB SQL of the vocabulary queries."""

from lonja.plans.matching_sql import DOMAIN
from lonja.plans.oracle import _up

_WORDS = lambda t: f"list_filter(string_split(trim(regexp_replace(upper(strip_accents({t})), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
_VALUES = " UNION ALL ".join(f"SELECT '{name}' AS name, {value} AS value FROM {t}" for t in "fm" for name, value in (("cost_log", "ln(1 + cost)"), ("weight", "weight"), ("factor_log", "ln(1 + factor)"), ("content_log", "ln(1 + content)"), ("total_log", "ln(1 + total)")))
SQL = {
    "vocabulary_encode": f"""WITH r AS (SELECT 'part' AS "of", p_partkey::BIGINT AS id, {_WORDS("concat_ws(' ', p_name, p_type, p_brand)")} AS w, 8 AS len, 20 AS size FROM part UNION ALL SELECT 'document', doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda t: t <> ''), NULL, 2000 FROM documents WHERE doc_id IS NOT NULL),
      e AS (SELECT "of", id, size, len, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM r), c AS (SELECT "of", word, size, count(*) AS n FROM e GROUP BY ALL),
      v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "of" ORDER BY n DESC, word) + 1 AS i, row_number() OVER (PARTITION BY "of" ORDER BY n DESC, word) AS k FROM c) WHERE k <= size),
      g AS (SELECT e."of", e.id, list(coalesce(v.i, 1) ORDER BY p) AS ids FROM e LEFT JOIN v ON v."of" = e."of" AND v.word = e.word WHERE len IS NULL OR p <= len GROUP BY ALL),
      h AS (SELECT r."of", r.id, list_concat(coalesce(ids, []), CASE WHEN len IS NULL THEN [] ELSE list_transform(range(0, greatest(len - len(coalesce(ids, [])), 0)), lambda x: 0) END) AS ids FROM r LEFT JOIN g ON g."of" = r."of" AND g.id = r.id)
      SELECT "of", id, len(ids) AS n, array_to_string(ids, ',') AS ids FROM h""",
    "numeric_normaliser": f"""WITH {DOMAIN}, v AS ({_VALUES}), s AS (SELECT name, avg(value) AS mean, var_pop(value) AS variance FROM v GROUP BY name)
      SELECT name, {_up("mean", 6)} AS mean, {_up("variance", 6)} AS variance, {_up("far", 4)} AS far FROM s JOIN (SELECT name, max(abs(value - mean) / greatest(sqrt(variance), 1e-7)) AS far FROM v JOIN s USING (name) GROUP BY name) USING (name)""",
}

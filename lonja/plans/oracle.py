"""DuckDB SQL of the registered queries."""

_MASTER = "SELECT DISTINCT l_suppkey AS ruc, l_partkey AS code, p_name, p_brand, p_type, p_size, p_retailprice AS cost FROM lineitem JOIN part ON l_partkey = p_partkey"
_FACTS = "SELECT l_suppkey AS ruc, l_partkey AS code, l_returnflag AS unit_buy, l_linestatus AS unit_bill, round_even(l_quantity / l_linenumber, 6) AS factor FROM lineitem WHERE l_quantity > 0 AND l_linenumber > 0"
_DICT = f"""facts AS ({_FACTS}), each_one AS (SELECT ruc, code, unit_buy, unit_bill, factor, count(*) AS n FROM facts WHERE factor > 0 GROUP BY ALL),
dict AS (SELECT ruc, code, unit_buy, unit_bill, arg_max(factor, (n, -factor)) AS factor, sum(n)::BIGINT AS samples, max(n) AS mode_samples, round_even(max(n) / sum(n), 6) AS confidence FROM each_one GROUP BY ALL)"""
_ORDER = "(mode_samples, confidence, samples, -factor)"
_LEVELS = f"""l1 AS (SELECT ruc, code, unit_buy, unit_bill, arg_max(factor, {_ORDER}) AS f1 FROM dict GROUP BY ALL),
l2 AS (SELECT ruc, code, arg_max(factor, {_ORDER}) AS f2 FROM dict GROUP BY ALL),
l3 AS (SELECT code, unit_buy, unit_bill, arg_max(factor, {_ORDER}) AS f3 FROM dict GROUP BY ALL),
l4 AS (SELECT code, arg_max(factor, {_ORDER}) AS f4 FROM dict GROUP BY ALL)"""
_FIND = "LEFT JOIN l1 USING (ruc, code, unit_buy, unit_bill) LEFT JOIN l2 USING (ruc, code) LEFT JOIN l3 USING (code, unit_buy, unit_bill) LEFT JOIN l4 USING (code)"
_LEVEL = "CASE WHEN f1 IS NOT NULL THEN 'exact' WHEN f2 IS NOT NULL THEN 'supplier_product' WHEN f3 IS NOT NULL THEN 'global_units' WHEN f4 IS NOT NULL THEN 'global_product' END AS level"
_quantity = lambda x: f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN 0 WHEN abs({x} - round_even({x}, 0)) <= 1e-3 THEN round_even({x}, 0) ELSE floor({x} * 1e6 + 0.5) / 1e6 END"
_jaccard = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
_overlap = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"
_rel = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN abs({a} - {b}) / greatest({a}, {b}) ELSE 1.0 END"
_sim = lambda a, b, k: f"CASE WHEN {a} > 0 AND {b} > 0 THEN exp(-{k} * abs({a} - {b}) / greatest({a}, {b})) ELSE 0.5 END"
_up = lambda x, n: f"(floor(({x}) * 1e{n} + 0.5) / 1e{n})"
_grams = lambda s: f"list_distinct(list_transform(range(1, greatest(length(replace({s}, ' ', '')) - 2, 1) + 1), lambda i: substring(replace({s}, ' ', ''), i, 3)))"

ORACLE_SQL = {
    "latest_cost_per_part": f"""SELECT l_partkey, {_up("l_extendedprice / l_quantity", 2)} AS cost, l_suppkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1""",
    "master_catalogue": f"""SELECT ruc, code, p_name || ' ' || p_brand AS description, s_name, CASE WHEN n_regionkey < 2 THEN 'A' WHEN n_regionkey = 2 THEN 'B' ELSE 'C' END AS zone,
        CASE WHEN p_size <> 0 THEN {_up("cost / p_size", 2)} END AS unit_cost FROM ({_MASTER}) LEFT JOIN supplier ON ruc = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "invoice_semi_join": """SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem
        WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE length(rtrim(s_name)) > 2 AND s_acctbal > 0)) WHERE rn = 1""",
    "composite_key_match": """WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
        SELECT a.l_orderkey AS order_key, a.l_partkey AS part_key, min(b.n) AS item FROM lineitem a JOIN b
        ON a.l_orderkey || '-' || right('000' || a.l_linenumber, 3) = b.l_orderkey || '-' || right('000' || b.n, 3) AND abs(a.l_extendedprice - b.l_extendedprice) < 1 GROUP BY ALL""",
    "conversion_dictionary": f"WITH {_DICT} SELECT * FROM dict",
    "conversion_lookup_cascade": f"WITH {_DICT}, {_LEVELS} SELECT ruc, code, unit_buy, unit_bill, coalesce(f1, f2, f3, f4) AS conversion, {_LEVEL} FROM (SELECT DISTINCT ruc, code, unit_buy, unit_bill FROM facts WHERE factor > 0) {_FIND}",
    "quantity_inference": f"""WITH {_DICT}, {_LEVELS}, x AS (SELECT l_orderkey, l_linenumber, {_LEVEL}, p_size, (50 * (1 + code % 20)) AS grams, CASE WHEN l_linenumber * coalesce(f1, f2, f3, f4) > 0 THEN 'conversion' WHEN p_retailprice > 0 AND l_extendedprice / p_retailprice > 0 THEN 'value' ELSE '' END AS origin,
        coalesce(CASE WHEN coalesce(f1, f2, f3, f4) > 0 THEN l_linenumber * coalesce(f1, f2, f3, f4) END, CASE WHEN p_retailprice > 0 THEN l_extendedprice / p_retailprice END) AS q
        FROM (SELECT *, l_suppkey AS ruc, l_partkey AS code, l_returnflag AS unit_buy, l_linestatus AS unit_bill FROM lineitem) {_FIND} LEFT JOIN part ON code = p_partkey),
        y AS (SELECT *, {_quantity("q")} AS quantity FROM x), z AS (SELECT *, {_quantity("(quantity * p_size)")} AS units FROM y)
        SELECT l_orderkey, l_linenumber, level, quantity, units, {_quantity("(units * grams)")} AS content_total, {_quantity("(units * (grams / 1000))")} AS weight_total, origin FROM z""",
    "exact_code_match": f"""WITH i AS (SELECT ruc, unnest([code::VARCHAR, '0' || code]) AS code, arg_max(p_name, (cost, p_name)) AS name FROM ({_MASTER}) GROUP BY ruc, code),
        x AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_suppkey WHEN l_suppkey % 2 = 0 THEN l_suppkey + 1 ELSE l_suppkey - 1 END AS ruc, repeat('0', l_linenumber % 3) || l_partkey AS code FROM lineitem),
        y AS (SELECT *, ltrim(code, '0') AS bare, CASE WHEN ruc % 2 = 0 THEN ruc + 1 ELSE ruc - 1 END AS other FROM x),
        z AS (SELECT y.*, a.name AS n0, b.name AS n1 FROM y LEFT JOIN i a ON a.ruc = y.ruc AND a.code = y.code LEFT JOIN i b ON b.ruc = other AND b.code = bare)
        SELECT l_orderkey, l_linenumber, l_suppkey, ruc, code, coalesce(n0, n1) AS matched, CASE WHEN n0 IS NOT NULL THEN 'exact' WHEN n1 IS NOT NULL THEN 'exact_equivalent' ELSE 'none' END AS kind,
        (coalesce(n0, n1) IS NOT NULL)::INT::DOUBLE AS score FROM z""",
    "alias_match": """WITH a AS (SELECT l_suppkey AS ruc, l_partkey AS code, l_orderkey % 3 AS t FROM lineitem), s AS (SELECT ruc, code, min(t) AS t FROM a GROUP BY ALL HAVING count(DISTINCT t) = 1),
        o AS (SELECT code, min(t) AS only_one FROM s GROUP BY ALL HAVING count(DISTINCT t) = 1)
        SELECT ruc, code, coalesce(t, only_one) AS master, CASE WHEN t IS NOT NULL THEN 'own' WHEN only_one IS NOT NULL THEN 'global' ELSE 'none' END AS source
        FROM (SELECT DISTINCT ruc, code FROM a) LEFT JOIN s USING (ruc, code) LEFT JOIN o USING (code)""",
    "char_ngram_similarity": f"SELECT p_partkey, round({_jaccard(_grams('upper(p_name)'), _grams('upper(p_type)'))}, 6) AS similarity, len({_grams('upper(p_name)')})::INT AS grams FROM part",
    "presentation_tiers": f"""WITH m AS (SELECT code, min(cost) AS cost, min(p_size)::DOUBLE AS size, min(p_type) AS kind FROM ({_MASTER}) GROUP BY code),
        x AS (SELECT *, l_extendedprice / l_quantity AS unit, l_returnflag = 'R' AS loose, l_returnflag = 'A' AND kind <> 'NONE' AS odd FROM lineitem JOIN m ON l_partkey = code),
        y AS (SELECT *, {_rel("unit", "cost")} AS f, least({_rel("l_quantity", "size")}, {_rel("l_extendedprice", "(cost * size)")}) AS best FROM x)
        SELECT l_orderkey, l_linenumber, CASE WHEN odd THEN 4 WHEN f <= 0.02 AND best <= 0.08 THEN 0 WHEN best <= 0.15 THEN 1 WHEN f <= 0.10 THEN 2 ELSE 3 END AS tier,
        round(0.20 * CASE WHEN loose OR kind = 'NONE' THEN 0.65 WHEN odd THEN 0.0 ELSE 1.0 END + 0.22 * {_sim("unit", "cost", 7.0)} + 0.20 * {_sim("l_quantity", "size", 8.0)} + 0.23 * {_sim("l_extendedprice", "(cost * size)", 8.0)} + 0.15 * {_sim("l_linenumber", "size", 8.0)}, 6) AS score FROM y""",
    "embedding_topk": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, label IS NOT NULL AND count(*) OVER (PARTITION BY label) > 10 AS enough FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v), 6) AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id AND (NOT q.enough OR q.label = e.label))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "ranking_metrics": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem), f AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN rank END) AS r FROM r GROUP BY 1)
        SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, count(*) AS n_groups FROM f HAVING count(r) > 0 UNION ALL SELECT 0, 0, 0, 0 FROM f HAVING count(r) = 0""",
    "threshold_sweep": """WITH x AS (SELECT least(floor(round(l_quantity / 50 * 100, 6)), 97) AS c, (l_returnflag = 'R')::INT AS y FROM lineitem), p AS (SELECT sum(y) AS positives FROM x),
        m AS (SELECT t, count(x.c) AS chosen, coalesce(sum(y), 0) AS hits FROM range(30, 98) g(t) LEFT JOIN x ON x.c >= t GROUP BY t),
        q AS (SELECT t / 100 AS threshold, round(CASE WHEN chosen > 0 THEN hits / chosen ELSE 0 END, 6) AS precision, round(CASE WHEN positives > 0 THEN hits / positives ELSE 0 END, 6) AS recall, round(CASE WHEN chosen + positives > 0 THEN 2 * hits / (chosen + positives) ELSE 0 END, 6) AS f1 FROM m, p)
        SELECT *, row_number() OVER (ORDER BY f1 DESC, precision DESC, threshold) = 1 AS best FROM q""",
    "class_weights": "SELECT p_type, count(*) AS n, round(sqrt(max(count(*)) OVER () / count(*)), 6) AS weight FROM part GROUP BY p_type",
    "group_split": "SELECT l_suppkey, count(*) AS n, CASE WHEN (l_suppkey * 2654435761) % 4294967296 % 100 < 20 THEN 'valid' ELSE 'train' END AS side FROM lineitem GROUP BY l_suppkey",
}

"""DuckDB SQL of the queries in ``queries``, under the same names."""

_E = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, embedding[1]::DOUBLE AS y FROM embeddings)"
_P = _E + ", p AS (SELECT a.id AS q, b.id AS c, a.v AS qv, b.v AS cv, a.y AS qy, b.y AS cy, a.label AS ql, b.label AS cl FROM e a JOIN e b ON a.id % 20 = 0 AND a.id <> b.id)"


def _topk(distance: str) -> str:
    return f"WITH {_P}, d AS (SELECT q, c, {distance} AS d FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, c) AS rk FROM d) SELECT q, c, rk, round(d, 6) AS d FROM r WHERE rk <= 10"


_SUM = "list_sum(list_transform(range(1, {n} + 1), lambda i: {x}))"
_J = _P + ", j AS (SELECT q, c, abs(qy - cy) AS o, list_cosine_distance(qv, cv) AS m, ql, cl FROM p)"
_R = _J + ", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, c) AS ork, row_number() OVER (PARTITION BY q ORDER BY m, c) AS mrk FROM j)"
_PROD = "sqrt(0.5 * (qv[1] - cv[{a}]) ** 2 + 0.3 * (qv[2] - cv[{b}]) ** 2 + 0.2 * (qv[3] - cv[{c}]) ** 2)"
_HALF = _J + """, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY q) AS n FROM j),
t AS (SELECT a.q, a.o - b.o AS od, a.m - b.m AS md FROM k a JOIN k b ON a.q = b.q AND a.i < a.n // 2 AND b.i = a.i + a.n - a.n // 2 WHERE a.o <> b.o)"""
_SCORE = "avg(CASE WHEN md = 0 THEN 0.5 WHEN sign(md) = sign(od) THEN 1.0 ELSE 0.0 END)"
_PRIM = r"""d0 AS (SELECT doc_id, source, lang, n_chars, (length(text) - length(replace(text, ',', '')))::DOUBLE AS p1, (length(text) - length(replace(text, '.', '')))::DOUBLE AS p2, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS p3 FROM documents),
s0 AS (SELECT quantile_cont(p1, [0.25, 0.5, 0.75]) AS a, quantile_cont(p2, [0.25, 0.5, 0.75]) AS b, quantile_cont(p3, [0.25, 0.5, 0.75]) AS c FROM d0),
z0 AS (SELECT doc_id, source, n_chars, round((p1 - a[2]) / greatest(a[3] - a[1], 1), 6) AS p1, round((p2 - b[2]) / greatest(b[3] - b[1], 1), 6) AS p2, round((p3 - c[2]) / greatest(c[3] - c[1], 1), 6) AS p3 FROM d0, s0)"""
_DEC = "e0 AS (SELECT quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM documents), k0 AS (SELECT doc_id, n_chars, len(list_filter(edges, lambda e: e <= n_chars))::INT AS decile FROM documents, e0)"


def _ranked(of: str = "") -> str:
    """All documents of a decile ranked for each query; ``of``: which documents are queries."""
    return f"""{_PRIM}, {_DEC}, h0 AS (SELECT z0.*, decile FROM z0 JOIN k0 USING (doc_id)),
j0 AS (SELECT a.doc_id AS q, a.source AS q_source, a.decile, b.doc_id AS c, round(greatest(abs(a.p1 - b.p1), abs(a.p2 - b.p2), abs(a.p3 - b.p3)), 6) AS o, abs(a.n_chars - b.n_chars) AS len, round(abs(a.p1 - b.p1), 6) AS first FROM h0 a JOIN h0 b ON a.decile = b.decile{of} AND a.doc_id <> b.doc_id),
r0 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, c) AS ork FROM j0)"""


_PAIRED = """x0 AS (SELECT a.q, a.c AS closer, b.c AS farther, a.ork AS closer_rank, b.ork AS farther_rank, b.ork - a.ork AS separation, sha256('seed-17' || chr(10) || a.q || chr(10) || a.c || chr(10) || b.c) AS selection_sha256,
  a.q_source, a.decile, a.len AS al, b.len AS bl, a.first AS af, b.first AS bf FROM r0 a JOIN r0 b ON a.q = b.q AND b.ork - a.ork BETWEEN 5 AND 25 AND a.o <> b.o),
y0 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY selection_sha256, closer, farther) - 1 AS pair_order FROM x0 QUALIFY pair_order < 128),
w0 AS (SELECT *, CASE WHEN al = bl THEN 0.5 WHEN al < bl THEN 1.0 ELSE 0.0 END::DOUBLE AS length, CASE WHEN af = bf THEN 0.5 WHEN af < bf THEN 1.0 ELSE 0.0 END::DOUBLE AS fst FROM y0)"""
#: the queries of the searches, and all documents as queries
_HARD, _HARD_ALL = (f"{_ranked(of)},\n{_PAIRED}" for of in (" AND a.doc_id % 20 = 0", ""))
_ROLE = """g0 AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), n0 AS (SELECT count(*) AS n FROM g0),
b0 AS (SELECT i, w, (SELECT n - 8 FROM n0) * w AS x FROM (VALUES (0, 0.5), (1, 0.25), (2, 0.125), (3, 0.125)) t(i, w)),
c0 AS (SELECT i, 2 + floor(x)::BIGINT AS base, row_number() OVER (ORDER BY -(x - floor(x)), i) AS place FROM b0),
u0 AS (SELECT i, base + (place <= (SELECT n FROM n0) - (SELECT sum(base) FROM c0))::INT AS quota FROM c0),
l0 AS (SELECT i, sum(quota) OVER (ORDER BY i) AS up FROM u0),
o0 AS (SELECT source, row_number() OVER (ORDER BY sha256('kindred-roles' || chr(0) || 'v1' || chr(0) || source), source) AS rk FROM g0),
role0 AS (SELECT source, rk, ['fit', 'iteration', 'selection', 'reserve'][(SELECT min(i) FROM l0 WHERE rk <= up) + 1] AS role FROM o0)"""
_COMP = """n1 AS (SELECT DISTINCT source || '/' || lang AS node, text FROM documents WHERE source IS NOT NULL), e1 AS (SELECT DISTINCT a.node AS a, b.node AS b FROM n1 a JOIN n1 b ON a.text = b.text AND a.node <> b.node),
reach AS (SELECT DISTINCT node AS a, node AS b FROM n1 UNION SELECT reach.a, e1.b FROM reach JOIN e1 ON reach.b = e1.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""
_M = _E + ", m AS (SELECT id, label, v[1:3] AS truth, [v[1] + v[4] * 0.2::DOUBLE, v[2] + v[5] * 0.2::DOUBLE, v[3] + v[6] * 0.2::DOUBLE] AS margins, [abs(v[4] * 0.2::DOUBLE), abs(v[5] * 0.2::DOUBLE), abs(v[6] * 0.2::DOUBLE)] AS res, (label % 2 + 2) % 2 = 0 AS cal FROM e)"
_BOX = _M + """, sc AS (SELECT [greatest(quantile_cont(res[1], 0.5), 1e-12), greatest(quantile_cont(res[2], 0.5), 1e-12), greatest(quantile_cont(res[3], 0.5), 1e-12)] AS s FROM m WHERE cal),
wo AS (SELECT greatest(res[1] / s[1], res[2] / s[2], res[3] / s[3]) AS w, row_number() OVER (ORDER BY greatest(res[1] / s[1], res[2] / s[2], res[3] / s[3])) AS k, count(*) OVER () AS n FROM m, sc WHERE cal),
ra AS (SELECT max(w) AS r FROM wo WHERE k = least(n, ceil((n + 1) * 0.9::DOUBLE))),
bx AS (SELECT m.*, list_transform([1, 2, 3], lambda i: margins[i] - r * s[i]) AS low, list_transform([1, 2, 3], lambda i: margins[i] + r * s[i]) AS high FROM m, sc, ra WHERE NOT cal),
dc AS (SELECT *, len(list_filter(low, lambda x: x > 0)) AS sure, len(list_filter(high, lambda x: x > 0)) AS maybe, len(list_filter(truth, lambda x: x > 0)) AS true_n, list_min(list_transform([1, 2, 3], lambda i: least(abs(low[i]), abs(high[i])))) AS score FROM bx)"""
_AGG = "count(*) AS n, round(avg((sure >= 2 OR maybe < 2)::INT), 6) AS coverage, round(avg(CASE WHEN sure >= 2 OR maybe < 2 THEN ((sure >= 2) <> (true_n >= 2))::INT END), 6) AS risk"

ORACLES = {
    "cosine_topk": _topk("list_cosine_distance(qv, cv)"),
    "euclidean_topk": _topk("list_distance(qv, cv)"),
    "diagonal_topk": _topk("sqrt(" + _SUM.format(n=64, x="(qv[i] - cv[i]) ** 2 / i") + ")"),
    "projection_topk": _topk("abs(" + _SUM.format(n=64, x="CASE WHEN i % 2 = 1 THEN qv[i] ELSE -qv[i] END") + " - " + _SUM.format(n=64, x="CASE WHEN i % 2 = 1 THEN cv[i] ELSE -cv[i] END") + ")"),
    "low_rank_topk": _topk("sqrt(" + _SUM.format(n=4, x="(list_sum(qv[i * 16 - 15:i * 16]) - list_sum(cv[i * 16 - 15:i * 16])) ** 2") + ")"),
    "weighted_product_topk": _topk(_PROD.format(a=1, b=2, c=3)),
    "scalar_collapse_topk": _topk("abs((0.5 * qv[1] + 0.3 * qv[2] + 0.2 * qv[3]) - (0.5 * cv[1] + 0.3 * cv[2] + 0.2 * cv[3]))"),
    "chebyshev_topk": _topk("greatest(abs(qv[1] - cv[1]), abs(qv[2] - cv[2]), abs(qv[3] - cv[3]))"),
    "scalar_topk": _topk("abs(qy - cy)"),
    "permuted_product_topk": f"WITH {_P}, d AS (" + " UNION ALL ".join(f"SELECT '{''.join(map(str, s))}' AS swap, q, c, {_PROD.format(a=s[0] + 1, b=s[1] + 1, c=s[2] + 1)} AS d FROM p" for s in [(0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]) + "), r AS (SELECT *, row_number() OVER (PARTITION BY swap, q ORDER BY d, c) AS rk FROM d) SELECT swap, q, c, rk, round(d, 6) AS d FROM r WHERE rk <= 5",
    "token_length_topk": "WITH r AS (SELECT a.doc_id AS q, b.doc_id AS c, abs(a.n_chars - b.n_chars) AS d, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(a.n_chars - b.n_chars), b.doc_id) AS rk FROM documents a JOIN documents b ON a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id) SELECT q, c, rk, d FROM r WHERE rk <= 10",
    "recall_at_k": f"WITH {_R} SELECT q, round(sum((ork <= 10 AND mrk <= 10)::INT) / least(10, count(*)), 6) AS recall_10, round(sum((ork <= 50 AND mrk <= 50)::INT) / least(50, count(*)), 6) AS recall_50 FROM r GROUP BY q",
    "neighbour_regret_at_k": f"WITH {_R}, a AS (SELECT q, " + ", ".join(f"avg(o) FILTER (mrk <= {k}) AS x{k}, avg(o) FILTER (ork <= {k}) AS y{k}, max(o) FILTER (mrk <= {k}) AS w{k}" for k in (10, 50)) + " FROM r GROUP BY q) SELECT q, " + ", ".join(f"round(x{k} - y{k}, 6) AS regret_{k}, round(CASE WHEN y{k} >= 1e-8 THEN x{k} / y{k} END, 6) AS relative_error_{k}, round(w{k}, 6) AS constraint_error_{k}" for k in (10, 50)) + " FROM a",
    "ndcg_at_k": f"WITH {_R}, s AS (SELECT q, coalesce(quantile_cont(o, 0.5) FILTER (o > 0), 1) AS s FROM r GROUP BY q), g AS (SELECT q, sum(exp(-o / s) / log2(mrk + 1)) FILTER (mrk <= 10) AS d, sum(exp(-o / s) / log2(ork + 1)) FILTER (ork <= 10) AS i FROM r JOIN s USING (q) GROUP BY q) SELECT q, round(CASE WHEN i = 0 THEN 1 ELSE d / i END, 6) AS ndcg FROM g",
    "within_tolerance_at_k": f"WITH {_R}, t AS (SELECT stddev_pop(y) * 0.05 AS tol FROM e) SELECT q, round(avg((o <= tol)::INT), 6) AS within FROM r, t WHERE mrk <= 10 GROUP BY q",
    "class_precision_recall_at_k": f"WITH {_R}, h AS (SELECT q, sum((ql = cl AND mrk <= 10)::INT) AS h, sum((ql = cl)::INT) AS n, least(10, count(*)) AS k FROM r GROUP BY q) SELECT q, round(h / k, 6) AS precision, round(CASE WHEN n > 0 THEN h / n END, 6) AS recall FROM h",
    "average_precision": f"WITH {_R}, h AS (SELECT q, ql = cl AS rel, mrk, sum((ql = cl)::INT) OVER (PARTITION BY q ORDER BY mrk) AS s FROM r) SELECT q, round(avg(s / mrk) FILTER (rel), 6) AS ap FROM h GROUP BY q",
    "spearman_per_query": f"WITH {_J}, k AS (SELECT q, rank() OVER (PARTITION BY q ORDER BY o) + (count(*) OVER (PARTITION BY q, o) - 1) / 2 AS x, rank() OVER (PARTITION BY q ORDER BY m) + (count(*) OVER (PARTITION BY q, m) - 1) / 2 AS y FROM j) SELECT q, round(corr(x, y), 6) AS rho FROM k GROUP BY q",
    "triplet_accuracy_halves": f"WITH {_HALF} SELECT q, round({_SCORE}, 6) AS accuracy, count(*) AS pairs FROM t GROUP BY q",
    "triplet_accuracy_pairweighted": f"WITH {_HALF} SELECT round({_SCORE}, 6) AS accuracy, count(*) AS pairs FROM t",
    "oracle_rank_percentiles": f"WITH {_R} SELECT round(quantile_cont(mrk, 0.5), 6) AS median, round(quantile_cont(mrk, 0.9), 6) AS p90 FROM r WHERE ork <= 10",
    "retrieval_summary": f"WITH {_R}, a AS (SELECT q, sum((ork <= 10 AND mrk <= 10)::INT) / 10 AS r, avg(o) FILTER (mrk <= 10) - avg(o) FILTER (ork <= 10) AS g, max(o) FILTER (mrk <= 10) AS x FROM r GROUP BY q) SELECT round(avg(r), 6) AS recall_10, round(avg(g), 6) AS regret_10, round(avg(x), 6) AS constraint_error_10, count(*) AS queries FROM a",
    "robust_scale": f"WITH {_PRIM} SELECT * FROM z0",
    "token_deciles": f"WITH {_DEC} SELECT * FROM k0",
    "hard_negative_pairs": f"WITH {_HARD} SELECT q, pair_order, closer, farther, closer_rank, farther_rank, separation, selection_sha256 FROM y0",
    "hard_negative_accuracy": f"WITH {_HARD_ALL} SELECT q, round(avg(length), 6) AS length, round(avg(fst), 6) AS first, count(*) AS pairs, sum((length = 0.5)::INT)::BIGINT AS length_ties FROM w0 GROUP BY q",
    "hard_negative_decision": f"WITH {_HARD}, a AS (SELECT q, avg(length) AS a, avg(fst) AS b, count(*) AS n FROM w0 GROUP BY q), t AS (SELECT avg(a) AS l, avg(b) AS f, sum(a * n) / sum(n) AS w FROM a) SELECT round(l, 6) AS length, round(f, 6) AS first, round(f - l, 6) AS gap, f - l >= 0.10 AS supported, round(w, 6) AS length_pairweighted FROM t",
    "accuracy_by_decile": f"WITH {_ranked()}, x0 AS (SELECT a.q, a.decile, CASE WHEN a.first = b.first THEN 0.5 WHEN a.first < b.first THEN 1.0 ELSE 0.0 END::DOUBLE AS fst FROM r0 a JOIN r0 b ON a.q = b.q AND b.ork - a.ork BETWEEN 5 AND 25 AND a.o <> b.o), a AS (SELECT decile, q, avg(fst) AS a FROM x0 GROUP BY ALL) SELECT decile, round(avg(a), 6) AS accuracy, count(*) AS queries FROM a GROUP BY decile",
    "leave_one_group_out": f"WITH {_HARD}, a AS (SELECT q_source AS source, q, avg(fst) AS a FROM w0 GROUP BY ALL), b AS (SELECT source, sum(a) AS s, count(*) AS n FROM a GROUP BY source) SELECT source, round(s / n, 6) AS accuracy, round(CASE WHEN sum(n) OVER () > n THEN (sum(s) OVER () - s) / (sum(n) OVER () - n) END, 6) AS without, n AS queries FROM b",
    "accuracy_by_group_quartile": f"WITH {_HARD}, sz AS (SELECT source, count(*) AS size FROM documents GROUP BY source), ed AS (SELECT quantile_cont(size, [0.25, 0.5, 0.75]) AS edges FROM sz), qt AS (SELECT source, len(list_filter(edges, lambda e: e <= size))::INT AS quartile FROM sz, ed), a AS (SELECT q_source AS source, q, avg(fst) AS a FROM w0 GROUP BY ALL) SELECT quartile, round(avg(a), 6) AS accuracy, count(*) AS queries FROM a JOIN qt USING (source) GROUP BY quartile",
    "stable_keys": "SELECT doc_id, sha256(concat_ws(chr(10), doc_id, source, lang)) AS key, sha256('kindred' || chr(0) || 'v1' || chr(0) || source) AS order_key FROM documents",
    "hash_limit": "SELECT lang, doc_id, rk FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(chr(10), doc_id, source))) AS rk FROM documents) WHERE rk <= 100",
    "hash_folds": "SELECT source, ((row_number() OVER (ORDER BY sha256(source), source) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)",
    "cross_split_dedup": "SELECT doc_id, source FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1)",
    "eligibility_reasons": "SELECT CASE WHEN text IS NULL OR text = '' THEN 'missing_text' WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 5000 THEN 'too_long' WHEN source IS NULL THEN 'missing_provenance' ELSE 'eligible' END AS reason, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1",
    "role_allocation": f"WITH {_ROLE} SELECT source, role, rk FROM role0",
    "role_counts": f"WITH {_ROLE} SELECT role, count(*) AS n, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars FROM documents JOIN role0 USING (source) GROUP BY role",
    "visible_roles": f"WITH {_ROLE} SELECT doc_id, source, role FROM documents JOIN role0 USING (source) WHERE role IN ('fit', 'iteration')",
    "exclusion_anti": "WITH j AS (SELECT doc_id, source, lang, toxic FROM documents JOIN labels USING (doc_id)) SELECT doc_id, source, lang FROM j ANTI JOIN (SELECT DISTINCT source, lang FROM j WHERE toxic = 1) b USING (source, lang)",
    "exact_overlap": "WITH g AS (SELECT count(*) AS n, count(DISTINCT source) AS roles FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) SELECT count(*) AS repeated, coalesce(sum((roles > 1)::INT), 0)::BIGINT AS cross_role, coalesce(sum(n) FILTER (roles > 1), 0)::BIGINT AS cross_role_rows, coalesce(max(n), 0) AS largest FROM g",
    "owner_role_matrix": "SELECT source, " + ", ".join(f"sum((quality = {q} AND toxic = {t})::INT)::BIGINT AS q{q}_t{t}" for q in (0, 1) for t in (0, 1)) + ", count(DISTINCT lang) AS langs FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "name_signatures": r"WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages) SELECT regexp_replace(regexp_replace(host, '^(www|m|blog|news|shop|docs)[0-9]*\.', ''), '[0-9]+', '', 'g') AS signature, count(*) AS pages, count(DISTINCT host) AS hosts, min(page_id) AS first_page FROM h GROUP BY 1",
    "hubs": "SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text ORDER BY n DESC, first_doc LIMIT 10",
    "components": f"WITH RECURSIVE {_COMP} SELECT node, component, count(*) OVER (PARTITION BY component)::INT AS size, sha256((SELECT string_agg(node, chr(10) ORDER BY node) FROM comp k WHERE k.component = comp.component) || chr(10) || 'protocol-1') AS component_id FROM comp",
    "role_crossings": f"WITH RECURSIVE {_COMP}, {_ROLE}, rw AS (SELECT source || '/' || lang AS node, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL), br AS (SELECT component, role, count(*) AS g, sum(n) AS r FROM comp JOIN rw USING (node) JOIN role0 USING (source) GROUP BY ALL) SELECT a.role AS role_a, b.role AS role_b, count(*) AS components, sum(a.g + b.g)::BIGINT AS groups, sum(a.r + b.r)::BIGINT AS rows FROM br a JOIN br b ON a.component = b.component AND a.role < b.role GROUP BY ALL",
    "completeness_counts": "SELECT count(*) AS n, sum((toxic IS NOT NULL)::INT)::BIGINT AS labelled, sum((source IS NOT NULL)::INT)::BIGINT AS sourced, sum((toxic IS NULL AND n_chars > 2000)::INT)::BIGINT AS unreviewed_long FROM documents LEFT JOIN labels USING (doc_id)",
    "query_truth": f"WITH {_M}, t AS (SELECT id, len(list_filter(truth, lambda x: x > 0)) AS n FROM m) SELECT id, n = 3 AS \"all\", n >= 1 AS \"any\", n >= 2 AS two_of_three FROM t",
    "conformal_quantiles": f"WITH {_M}, r AS (SELECT unnest([0, 1, 2])::INT AS primitive, unnest(res) AS r FROM m WHERE cal), k AS (SELECT *, row_number() OVER (PARTITION BY primitive ORDER BY r) AS k, count(*) OVER (PARTITION BY primitive) AS n FROM r) SELECT primitive, alpha::DOUBLE AS alpha, round(max(r), 6) AS radius FROM k, (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.20::DOUBLE)) a(alpha) WHERE k = least(n, ceil((n + 1) * (1 - alpha))) GROUP BY ALL",
    "interval_decision": f"WITH {_BOX}, f AS (SELECT id, unnest(['all', 'any', 'two_of_three']) AS form, unnest([3, 1, 2]) AS need, sure, maybe, score FROM dc) SELECT id, form, sure >= need AS prediction, sure >= need OR maybe < need AS accepted, round(score, 6) AS score FROM f",
    "selective_by_group": f"WITH {_BOX} SELECT label, sum((sure >= 2 OR maybe < 2)::INT)::BIGINT AS n_accepted, {_AGG} FROM dc GROUP BY label",
    "selective_by_regime": f"WITH {_BOX}, g AS (SELECT *, CASE WHEN list_min(list_transform(truth, lambda x: abs(x))) <= 0.10 THEN 'weak' WHEN list_max(list_transform([1, 2, 3], lambda i: abs(truth[i] - margins[i]))) >= 1.5 THEN 'shifted' WHEN list_max(list_transform(truth, lambda x: abs(x))) <= 0.25 THEN 'absent' ELSE 'supported' END AS regime FROM dc), a AS (SELECT regime, {_AGG} FROM g GROUP BY regime) SELECT f.regime, coalesce(n, 0)::BIGINT AS n, coverage, risk FROM (VALUES ('weak'), ('shifted'), ('absent'), ('supported')) f(regime) LEFT JOIN a USING (regime)",
    "interval_coverage": f"WITH {_BOX}, i AS (SELECT list_transform([1, 2, 3], lambda i: truth[i] >= low[i] AND truth[i] <= high[i]) AS x FROM dc) SELECT round(avg(x[1]::INT), 6) AS p0, round(avg(x[2]::INT), 6) AS p1, round(avg(x[3]::INT), 6) AS p2, round(avg((x[1] AND x[2] AND x[3])::INT), 6) AS joint FROM i",
    "oracle_support": f"WITH {_M}, t AS (SELECT id, len(list_filter(truth, lambda x: x > 0)) AS n, list_min(list_transform(truth, lambda x: abs(x))) AS s FROM m) SELECT id, n = 3 AS \"all\", n >= 1 AS \"any\", n >= 2 AS two_of_three, s > 0.02 AS accepted, round(s, 6) AS score FROM t",
    "risk_coverage": f"WITH {_M}, s AS (SELECT id, round(list_min(list_transform(margins, lambda x: abs(x))), 9) AS score, (len(list_filter(margins, lambda x: x > 0)) = 3) <> (len(list_filter(truth, lambda x: x > 0)) = 3) AS wrong FROM m), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk, count(*) OVER () AS n FROM s), a AS (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS anchor) SELECT anchor, floor(max(n) * anchor)::BIGINT AS accepted, round(sum(wrong::INT) FILTER (rk <= floor(n * anchor)) / nullif(floor(max(n) * anchor), 0), 6) AS risk FROM k, a GROUP BY anchor",
    "residual_mass": f"WITH {_M}, c AS (SELECT truth[1] - margins[1] AS r FROM m WHERE cal), x AS (SELECT id, (SELECT avg((m.margins[1] > -r)::INT) FROM c) AS p0, (SELECT count(*) FILTER (r > -m.margins[1]) / count(*) FROM c) AS p FROM m WHERE NOT cal) SELECT id, round(p, 6) AS p, p > 0.5 AS prediction, p <= 0.05 OR p >= 0.95 AS accepted FROM x",
    "payload_commitments": "WITH l AS (SELECT event_type, substr(sha256(event_id::VARCHAR), 1, 2) AS b, event_id, concat_ws('|', event_id, user_id, event_type, props) AS line FROM events), h AS (SELECT event_type, b, sha256(string_agg(line, '' ORDER BY event_id)) AS h, count(*) AS n FROM l GROUP BY ALL) SELECT event_type, sha256(string_agg(h, '' ORDER BY b)) AS commitment, sum(n)::BIGINT AS n FROM h GROUP BY event_type",
    "chain_links": "SELECT user_id, event_id, lag(sha256(event_id || '|' || event_type)) OVER w AS previous_sha256, event_id - lag(event_id) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "confidence_at_half": f"WITH {_M}, p AS (SELECT id, round(1 / (1 + exp(-margins[1])), 9) AS p FROM m), k AS (SELECT *, greatest(p, 1 - p) AS score, row_number() OVER (ORDER BY greatest(p, 1 - p) DESC, id) AS rk, count(*) OVER () AS n FROM p) SELECT id, p > 1 - p AS prediction, rk <= floor(n * 0.5) AS accepted, round(score, 6) AS score FROM k",
    "independent_interval_decision": f"WITH {_M}, r AS (SELECT unnest([1, 2, 3]) AS i, unnest(res) AS r FROM m WHERE cal), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY r) AS k, count(*) OVER (PARTITION BY i) AS n FROM r), h AS (SELECT list(r ORDER BY i) AS h FROM k WHERE k = least(n, ceil((n + 1) * 0.9::DOUBLE))), b AS (SELECT id, list_transform([1, 2, 3], lambda i: margins[i] - h[i]) AS low, list_transform([1, 2, 3], lambda i: margins[i] + h[i]) AS high FROM m, h WHERE NOT cal), d AS (SELECT *, len(list_filter(low, lambda x: x > 0)) AS sure, len(list_filter(high, lambda x: x > 0)) AS maybe FROM b) SELECT id, sure >= 2 AS prediction, sure >= 2 OR maybe < 2 AS accepted, round(list_min(list_transform([1, 2, 3], lambda i: least(abs(low[i]), abs(high[i])))), 6) AS score FROM d",
    "manifest_triplet_accuracy": f"WITH {_E}, k AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM e), t AS (SELECT id AS q, v AS qv, y AS qy, n, unnest(range(0, 256)) AS i FROM k WHERE id % 20 = 0), d AS (SELECT *, ('0x' || substr(sha256(q || '|' || i || '|a'), 1, 8))::BIGINT % n AS a, ('0x' || substr(sha256(q || '|' || i || '|b'), 1, 8))::BIGINT % n AS b FROM t), s AS (SELECT q, abs(qy - x.y) - abs(qy - z.y) AS od, round(list_cosine_distance(qv, x.v), 12) - round(list_cosine_distance(qv, z.v), 12) AS md FROM d JOIN k x ON x.place = a JOIN k z ON z.place = b) SELECT q, round({_SCORE}, 6) AS accuracy, count(*) AS triplets FROM s WHERE od <> 0 GROUP BY q",
}

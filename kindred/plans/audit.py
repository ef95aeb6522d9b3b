"""Queries over the audit operators, and their DuckDB SQL. Repositories: a source as owner, and one of eight names by document."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import names as N
from kindred.functions.code import code_primitives, normal_tokens
from kindred.operators import audit as A
from kindred.operators.dominance import at_least_of, counts_above
from kindred.operators import duplicates as D
from kindred.operators.ledger import streamed_digests
from kindred.operators import retrieval as R
from kindred.plans import queries as Q
from kindred.plans.sql import _PRIM
from kindred.plans.sql import ORACLES as _BEFORE
from kindred.sources.readers import table
from kindred.storage import staged

NAMES = ("python-tool", "tool-v2", "Tool_fork", "django-core-utils", "aiohttp-client", "tool-2", "web-app-py", "data")
ROLES = ("fit", "iteration", "selection", "reserve")
PAIRS = [("fit", "iteration"), ("fit", "selection"), ("fit", "reserve"), ("iteration", "selection"), ("iteration", "reserve")]
#: A statement for each line of a text, by its commas: code, tokens, and what it adds to the complexity, the depth it needs and its call target.
STATEMENTS = [
    ("    x = step_{i}(x)", "NAME = NAME ( NAME )", 0, 0, None),
    ("    if x > {n}:\n        x = clip(x)", "if NAME > NUMBER : NAME = NAME ( NAME )", 1, 1, "clip"),
    ("    for y in x:\n        if y and x:\n            keep(y)", "for NAME in NAME : if NAME and NAME : NAME ( NAME )", 3, 2, "keep"),
    ("    z = [y for y in x if y]", "NAME = [ NAME for NAME in NAME if NAME ]", 2, 1, None),
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source is not null")
    repository = F.concat("source", F.lit("/"), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int")))
    d = d.withColumn("repository", repository)
    return d.withColumn("role", F.element_at(F.array(*map(F.lit, ROLES)), (F.conv(F.substring(F.md5("repository"), 1, 2), 16, 10).cast("int") % 4 + 1)))


def _repositories(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("repository", "role").agg(F.count("*").alias("row_count"))


def repository_names(spark, sf_dir):
    """Owner, name, signatures and family of every repository."""
    r = _repositories(spark, sf_dir).select("repository", N.normalised(F.col("repository")).alias("normalised"), N.owner(F.col("repository")).alias("owner"), N.name(F.col("repository")).alias("name"), N.signatures(F.col("repository")).alias("s"), N.family_name(F.col("repository")).alias("family_name"))
    return r.select("repository", "normalised", "owner", "name", "s.*", "family_name")


def name_family_report(spark, sf_dir):
    return A.name_families(_repositories(spark, sf_dir))


def owner_role_groups(spark, sf_dir):
    return A.owners_by_role(_repositories(spark, sf_dir), ROLES)


def owner_role_analysis(spark, sf_dir):
    return A.owner_role_pairs(_repositories(spark, sf_dir), PAIRS, ROLES)


def role_disjointness(spark, sf_dir):
    """Owners that stand in several roles; repositories never do."""
    d = _documents(spark, sf_dir)
    A.require_disjoint(d, "repository", "role")
    return A.in_two_roles(d.withColumn("owner", N.owner(F.col("repository"))), "owner", "role")


def fit_calibration_split(spark, sf_dir):
    """The first quarter (rounded up) of the fit repositories by hash calibrates, the rest fits."""
    from kindred.operators.keys import global_rank

    r = _repositories(spark, sf_dir).where("role = 'fit'").select("repository", F.sha2(F.concat_ws("|", F.lit("fit-partition"), "repository"), 256).alias("h"))
    n = max(1, math.ceil(r.count() * 0.25))
    return global_rank(r, [F.col("h"), F.col("repository")]).select("repository", F.when(F.col("rk") <= n, "calibration").otherwise("model_fit").alias("part"))


def minimum_support(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return A.with_support(d, "repository", 8).groupBy("repository").agg(F.count("*").alias("n"))


def largest_repositories(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy("repository").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).orderBy(F.desc("n"), "repository").limit(10)


def registry_differences(spark, sf_dir):
    """Documents without a label, and labels without a document: both ways of the difference."""
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_anti").withColumn("missing", F.lit("label")).unionByName(l.join(d, "doc_id", "left_anti").withColumn("missing", F.lit("document")))


# near duplicates across roles and repositories


def _prints(spark, sf_dir) -> DataFrame:
    d = _documents(spark, sf_dir)
    return staged(d.select("doc_id", "repository", "role", F.sha2("text", 256).alias("h"), F.size(D.prose_tokens(F.col("text"))).alias("tokens"), D.simhash(D.prose_tokens(F.col("text"))).alias("f")), "prints")


def near_duplicate_report(spark, sf_dir):
    return A.near_duplicate_report(_prints(spark, sf_dir), "f", "role", "repository")


def near_duplicate_buckets(spark, sf_dir):
    return A.bucket_sizes(_prints(spark, sf_dir), "f", 4)


def _near_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of near fingerprints in different repositories, by the first row of a fingerprint in each repository."""
    p = _prints(spark, sf_dir)
    least = p.groupBy("f", "repository").agg(F.min(F.struct("doc_id", "h", "tokens")).alias("x")).select("f", "repository", "x.*")
    side = lambda s, f: least.select(F.col("f").alias(f), *[F.col(c).alias(f"{s}_{c}") for c in ("doc_id", "repository", "h", "tokens")])
    both = A.close_prints(p, "f").join(side("a", "f"), "f").join(side("b", "g"), "g")
    return both.where("a_repository <> b_repository and (f < g or a_doc_id < b_doc_id)")


def near_pair_labels(spark, sf_dir):
    p = _near_pairs(spark, sf_dir)
    own, fam = (lambda f: f(F.col("a_repository")) == f(F.col("b_repository"))), N.family_name
    label = A.near_pair_label(F.col("a_h") == F.col("b_h"), own(N.owner), own(fam), F.least("a_tokens", "b_tokens"), F.col("distance"))
    return p.groupBy(label.alias("label"), "distance").agg(F.count("*").alias("pairs"))


def near_pair_degrees(spark, sf_dir):
    """How many documents have how many near partners, and the smallest of them."""
    d = A.degrees(_near_pairs(spark, sf_dir), "a_doc_id", "b_doc_id")
    return d.groupBy("degree").agg(F.count("*").alias("documents"), F.min("key").alias("first_doc"))


# code


def _code(spark, sf_dir) -> DataFrame:
    """Each document as a function of Python: a statement for every line of its text, chosen by the number of commas in it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))

    def statement(line: Column, i: Column) -> Column:
        n = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
        filled = [F.replace(F.replace(F.lit(code), F.lit("{i}"), (i % 5).cast("string")), F.lit("{n}"), n.cast("string")) for code, *_ in STATEMENTS]
        return F.element_at(F.array(*filled), (n % 4 + 1).cast("int"))

    body = F.array_join(F.transform("lines", statement), "\n")
    return d.select("doc_id", F.concat(F.lit("def f(x):\n"), body, F.lit("\n    return x\n")).alias("code"))


def code_primitives_of_texts(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", code_primitives(F.col("code")).alias("p")).select("doc_id", "p.complexity", "p.depth", "p.calls", "p.reason")


def code_tokens_of_texts(spark, sf_dir):
    t = _code(spark, sf_dir).select("doc_id", normal_tokens(F.col("code")).alias("tokens"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("sha256"))


# selective decisions


def signed_margins(spark, sf_dir):
    """Primitives less their median, in units of their interquartile range (1 at least)."""
    d = Q._scaled(spark, sf_dir)
    return d.select("doc_id", *[F.col(f"p{i + 1}").alias(f"m{i}") for i in range(3)], (F.least("p1", "p2", "p3") > 0).alias("all_positive"))


def _mass(spark, sf_dir) -> DataFrame:
    """Share of all calibration residual vectors under which a row's query holds, for each form: residuals above minus the row's margins, counted by coordinates."""
    m = staged(Q._margins(spark, sf_dir), "margins")
    test, cal = m.where("not calibration"), m.where("calibration")
    at = lambda v: [F.get(v, F.lit(i)).alias(f"x{i}") for i in range(3)]
    points = cal.select("id", *at(F.zip_with("truth", "margins", lambda t, p: t - p)))
    above = counts_above(points, test.select("id", *at(F.transform("margins", lambda p: -p))), "id", ["x0", "x1", "x2"])
    n = cal.count()
    share = lambda form: at_least_of(3 if form.kind == "all" else 1 if form.kind == "any" else form.k, 3) / n if n else F.lit(None).cast("double")
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("form"), share(form).alias("p"), form.truth(F.col("truth")).alias("truth")) for name, form in Q.FORMS.items()])).alias("x")
    out = above.join(test.select("id", "label", "truth"), "id").select("id", "label", rows).select("id", "label", "x.*")
    accepted = (F.col("p") <= 0.05) | (F.col("p") >= 0.95)
    return out.withColumn("prediction", F.col("p") > 0.5).withColumn("accepted", accepted).withColumn("score", F.greatest(F.col("p"), 1 - F.col("p"))).withColumn("reason", F.when(accepted, "accepted_empirical_support_mass").otherwise("refused_empirical_support_disagreement"))


def empirical_residual_mass(spark, sf_dir):
    return _mass(spark, sf_dir).select("id", "form", F.round("p", 6).alias("p"), "prediction", "accepted", F.round("score", 6).alias("score"), "reason")


def selective_diagnostics(spark, sf_dir):
    d = A.selective_diagnostics(_mass(spark, sf_dir), ["form"], "label")
    return d.select("form", "rows", "accepted", "refused", "errors", "groups_with_acceptance", "refusals", *[F.round(c, 6).alias(c) for c in ("coverage", "risk", "mean_risk", "std_risk", "min_risk", "max_risk")])


# commitments


def ordered_commitments(spark, sf_dir):
    d = _documents(spark, sf_dir).select("repository", "doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "lang", F.col("n_chars").cast("string")).alias("line"))
    return A.ordered_commitment(d, ["repository"], "doc_id", "line")


def sequence_hashes(spark, sf_dir):
    d = _documents(spark, sf_dir).select("repository", "doc_id", F.concat(F.lit("key-"), F.col("doc_id").cast("string")).alias("key"))
    return A.sequence_hash(d, ["repository"], "key", "doc_id")


def component_commitments(spark, sf_dir):
    """Component ids as the SHA-256 of canonical JSON: sorted members and the protocol."""
    d, e = Q._graph(spark, sf_dir)
    c = Q.G.components_of(d, e, "node", "protocol-1")
    out = streamed_digests(c, ["component"], ["node"], A.json_item(F.col("node")), '{"members":[', ",", '],"protocol_sha256":"protocol-1"}')
    return out.select("component", F.col("sha256").alias("component_id"), F.col("n").cast("int").alias("size"))


def manifest_checks(spark, sf_dir):
    """The hard-negative manifest checked as a reader would: order, and digests computed anew."""
    p = Q.hard_negative_pairs(spark, sf_dir)
    expected = F.sha2(F.concat_ws("\n", F.lit("seed-17"), F.col("q").cast("string"), F.col("closer").cast("string"), F.col("farther").cast("string")), 256)
    return A.manifest_faults(p, "q", "pair_order", "selection_sha256", expected)


def allocation_counts(spark, sf_dir):
    """Repositories and rows of each role, with the commitment of its repositories; nothing is allocated twice."""
    r = _repositories(spark, sf_dir)
    by = A.ordered_commitment(r.withColumn("line", F.col("repository")), ["role"], "repository", "line")
    return r.groupBy("role").agg(F.sum("row_count").alias("row_count"), (F.count("*") - F.countDistinct("repository")).alias("repeated")).join(by, "role")


def fold_splits(spark, sf_dir):
    """60 / 20 / 20 split of all vectors by hash order, exact in size."""
    from kindred.operators.keys import global_rank

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.sha2(F.concat(F.lit("split|"), F.col("vec_id").cast("string")), 256).alias("h"))
    n = e.count()
    return global_rank(e, [F.col("h"), F.col("vec_id")]).select("vec_id", F.when(F.col("rk") <= n * 6 // 10, "train").when(F.col("rk") <= n * 8 // 10, "validation").otherwise("test").alias("split"))


def quantile_groups(spark, sf_dir):
    """Sources by the number of their documents, and their place among all."""
    d = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return d.select("source", "n", F.round(F.percent_rank().over(W.orderBy("n")), 6).alias("place"))  # one row per source


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LIST = "[" + ", ".join(map(_text, NAMES)) + "]"
_D = f"d0 AS (SELECT *, source || '/' || ({_LIST})[(doc_id % 8 + 1)::INT] AS repository FROM documents WHERE source IS NOT NULL), d AS (SELECT *, ['fit', 'iteration', 'selection', 'reserve'][('0x' || substr(md5(repository), 1, 2))::INT % 4 + 1] AS role FROM d0)"
_REPO = _D + ", r AS (SELECT repository, role, count(*) AS row_count FROM d GROUP BY ALL)"
_COPY = "[" + ", ".join(map(_text, N.COPY_WORDS)) + "]"
_STRIP = "lower(regexp_extract(repository, '^[^/]+/(.+)$', 1))"
for _ in range(6):
    _STRIP = f"regexp_replace({_STRIP}, {_text(N.AFFIXES)}, '', 'g')"
_FAMILY = f"replace({_STRIP}, '_', '-')"
_SIG = _REPO + rf""", w AS (SELECT *, regexp_extract_all(lower(regexp_extract(repository, '[^/]*$')), '[a-z0-9]+') AS ws FROM r),
l AS (SELECT *, coalesce(list_max(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_contains({_COPY}, ws[i]) OR regexp_full_match(ws[i], '[0-9]+|v[0-9]+') THEN 0 ELSE i END)), 0) AS z FROM w),
s AS (SELECT *, array_to_string(ws, '-') AS exact, CASE WHEN z > 0 THEN array_to_string(ws[1:z], '-') ELSE array_to_string(ws, '-') END AS family FROM l)"""
_OWN = _REPO + ", o AS (SELECT lower(split_part(repository, '/', 1)) AS owner, " + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}_repositories, coalesce(sum(row_count) FILTER (role = '{r}'), 0)::BIGINT AS {r}_rows" for r in ROLES) + ", count(DISTINCT role) AS roles FROM r GROUP BY 1 HAVING count(DISTINCT role) >= 2)"
#: SimHash of prose: 64 signs of sums of bits.
_HASH = r"""t AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS ws FROM {source}),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN ['<empty>'] ELSE list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i:i + 4], chr(0))) END AS gs FROM t),
b AS (SELECT doc_id, ('0x' || substr(sha256(x), 1, 16))::UBIGINT AS v FROM (SELECT doc_id, unnest(gs) AS x FROM g)),
c AS (SELECT doc_id, i, 2 * sum(((v >> i) & 1)::INT) >= count(*) AS one FROM b, range(64) AS u(i) GROUP BY ALL),
f AS (SELECT doc_id, sum(CASE WHEN one THEN (1::UBIGINT << i::UBIGINT)::HUGEINT ELSE 0 END)::UBIGINT AS f FROM c GROUP BY doc_id)"""
_HEX = "lower(lpad(hex(f), 16, '0'))"
_P = _D + ", " + _HASH.format(source="d") + ", p AS (SELECT d.doc_id, repository, role, sha256(text) AS h, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS tokens, f FROM d JOIN f USING (doc_id))"
_NEAR = _P + """, k AS (SELECT f, repository, min(doc_id) AS doc_id, arg_min(h, doc_id) AS h, arg_min(tokens, doc_id) AS tokens FROM p GROUP BY f, repository),
n AS (SELECT a.doc_id AS a_doc, b.doc_id AS b_doc, a.repository AS ar, b.repository AS br, a.h AS ah, b.h AS bh, least(a.tokens, b.tokens) AS tokens, bit_count(xor(a.f, b.f)) AS distance
  FROM k a JOIN k b ON (a.f < b.f OR a.f = b.f AND a.doc_id < b.doc_id) AND bit_count(xor(a.f, b.f)) <= 3 AND a.repository <> b.repository)"""
_MM = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT id, label, v[1:3] AS truth, list_transform([1, 2, 3], lambda i: v[i] + v[i + 3] * 0.2) AS margins, label % 2 = 0 AS cal FROM e)"
_FORM = {"all": "len(list_filter({x}, lambda x: x > 0)) = 3", "any": "len(list_filter({x}, lambda x: x > 0)) >= 1", "two_of_three": "len(list_filter({x}, lambda x: x > 0)) >= 2"}
_MASS = (
    f"{_MM}, c AS (SELECT list_transform([1, 2, 3], lambda i: truth[i] - margins[i]) AS r FROM m WHERE cal), s AS (SELECT id, label, truth, list_transform([1, 2, 3], lambda i: margins[i] + r[i]) AS x FROM m, c WHERE NOT cal), z AS ("
    + " UNION ALL ".join(f"SELECT id, label, '{n}' AS form, avg(({c.format(x='x')})::INT) AS p, first({c.format(x='truth')}) AS truth FROM s GROUP BY id, label" for n, c in _FORM.items())
    + "), y AS (SELECT *, p > 0.5 AS prediction, p <= 0.05 OR p >= 0.95 AS accepted, greatest(p, 1 - p) AS score FROM z)"
)
_WHY = "CASE WHEN accepted THEN 'accepted_empirical_support_mass' ELSE 'refused_empirical_support_disagreement' END"

_LINES = "s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, r.i AS i, ((length(ls[i + 1]) - length(replace(ls[i + 1], ',', ''))) % 4 + 1)::INT AS k FROM s, LATERAL (SELECT unnest(range(len(ls))) AS i) r)"

ORACLES = {
    "repository_names": _SIG + f" SELECT repository, lower(trim(repository)) AS normalised, lower(split_part(repository, '/', 1)) AS owner, lower(regexp_extract(repository, '^[^/]+/(.+)$', 1)) AS name, exact, family, {_FAMILY} AS family_name FROM s",
    "name_family_report": _SIG + ", x AS (SELECT 'exact' AS kind, exact AS signature, role, repository FROM s UNION ALL SELECT 'family', family, role, repository FROM s) SELECT kind, signature, count(DISTINCT role) AS roles, count(DISTINCT repository) AS repositories FROM x WHERE signature <> '' GROUP BY ALL HAVING count(DISTINCT role) >= 2 AND count(DISTINCT repository) >= 2",
    "owner_role_groups": _OWN + " SELECT * FROM o",
    "owner_role_analysis": _OWN + " SELECT count(*) AS owners, " + ", ".join(f"count(*) FILTER ({a}_repositories > 0 AND {b}_repositories > 0) AS {a}__{b}" for a, b in PAIRS) + ", count(*) FILTER (roles >= 3) AS three_or_more FROM o",
    "role_disjointness": _D + " SELECT lower(split_part(repository, '/', 1)) AS owner, count(DISTINCT role) AS roles FROM d GROUP BY 1 HAVING count(DISTINCT role) > 1",
    "fit_calibration_split": _REPO + ", k AS (SELECT repository, row_number() OVER (ORDER BY sha256('fit-partition|' || repository), repository) AS rk, greatest(1, ceil(count(*) OVER () * 0.25)) AS n FROM r WHERE role = 'fit') SELECT repository, CASE WHEN rk <= n THEN 'calibration' ELSE 'model_fit' END AS part FROM k",
    "minimum_support": _D + " SELECT repository, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 8",
    "largest_repositories": _D + " SELECT repository, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM d GROUP BY 1 ORDER BY n DESC, repository LIMIT 10",
    "registry_differences": "SELECT doc_id, 'label' AS missing FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'document' FROM labels ANTI JOIN documents USING (doc_id)",
    "near_duplicate_report": _P + ", n AS (SELECT bit_count(xor(a.f, b.f)) AS distance, least(a.f, b.f) AS x, greatest(a.f, b.f) AS y FROM p a JOIN p b ON a.doc_id < b.doc_id AND a.role <> b.role AND a.repository <> b.repository AND bit_count(xor(a.f, b.f)) <= 3) SELECT distance::INT AS distance, count(*) AS pairs, count(DISTINCT (x, y)) AS fingerprint_pairs FROM n GROUP BY 1",
    "near_duplicate_buckets": _P + ", u AS (SELECT band, (f >> (16 * band)::UBIGINT) & 65535 AS v, count(*) AS n FROM p, range(4) AS b(band) GROUP BY ALL) SELECT band::INT AS band, count(*) AS buckets, max(n) AS largest, count(*) FILTER (n > 4) AS oversized, coalesce(sum(n) FILTER (n > 4), 0)::BIGINT AS rows_left_out FROM u GROUP BY 1",
    "near_pair_labels": _NEAR + f", q AS (SELECT *, {_FAMILY.replace('repository', 'ar')} = {_FAMILY.replace('repository', 'br')} AS fam, lower(split_part(ar, '/', 1)) = lower(split_part(br, '/', 1)) AS own FROM n) SELECT CASE WHEN ah = bh AND own THEN 'EXACT_AST_RELATED_OWNER' WHEN tokens <= 8 AND distance = 0 AND ah <> bh THEN 'GENERIC_SHORT_FUNCTION_COLLISION' WHEN own THEN 'SAME_OWNER_NEAR_MATCH' WHEN fam THEN 'SAME_FAMILY_NAME_NEAR_MATCH' WHEN tokens <= 8 THEN 'POSSIBLE_TEMPLATE_OR_BOILERPLATE' ELSE 'UNRESOLVED_NEAR_MATCH' END AS label, distance::INT AS distance, count(*) AS pairs FROM q GROUP BY ALL",
    "near_pair_degrees": _NEAR + ", q AS (SELECT key, count(*) AS degree FROM (SELECT a_doc AS key FROM n UNION ALL SELECT b_doc FROM n) GROUP BY key) SELECT degree, count(*) AS documents, min(key) AS first_doc FROM q GROUP BY degree",
    "simhash_fingerprints": "WITH " + _HASH.format(source="documents") + f" SELECT doc_id, {_HEX} AS simhash_hex, [(f & 65535)::INT, ((f >> 16) & 65535)::INT, ((f >> 32) & 65535)::INT, ((f >> 48) & 65535)::INT] AS bands FROM f",
    "simhash_near_pairs": "WITH " + _HASH.format(source="documents") + ", p AS (SELECT doc_id, source, f FROM documents JOIN f USING (doc_id)) SELECT a.doc_id AS left_key, b.doc_id AS right_key, bit_count(xor(a.f, b.f))::INT AS distance FROM p a JOIN p b ON a.doc_id < b.doc_id AND a.source <> b.source AND bit_count(xor(a.f, b.f)) <= 3",
    "code_primitives_of_texts": f"WITH {_LINES} SELECT doc_id, (1 + sum([0, 1, 3, 2][k]))::DOUBLE AS complexity, max([0, 1, 2, 1][k])::DOUBLE AS depth, (count(DISTINCT i % 5) FILTER (k = 1) + count(DISTINCT k) FILTER (k = 2 OR k = 3))::DOUBLE AS calls, NULL::VARCHAR AS reason FROM l GROUP BY doc_id",
    "code_tokens_of_texts": f"WITH {_LINES}, t AS (SELECT doc_id, 'def NAME ( NAME ) : ' || string_agg([{', '.join(repr(x[1]) for x in STATEMENTS)}][k], ' ' ORDER BY i) || ' return NAME' AS t FROM l GROUP BY doc_id) SELECT doc_id, length(t) - length(replace(t, ' ', '')) + 1 AS tokens, sha256(t) AS sha256 FROM t",
    "empirical_residual_mass": f"WITH {_MASS} SELECT id, form, round(p, 6) AS p, prediction, accepted, round(score, 6) AS score, {_WHY} AS reason FROM y",
    "selective_diagnostics": f"WITH {_MASS}, g AS (SELECT form, label, count(*) AS n, count(*) FILTER (accepted) AS a, sum((prediction <> truth)::INT) FILTER (accepted) AS e FROM y GROUP BY ALL), h AS (SELECT form, sum(n)::BIGINT AS rows, sum(a)::BIGINT AS accepted, coalesce(sum(e), 0)::BIGINT AS errors, count(*) FILTER (a > 0) AS groups_with_acceptance, avg(e / a) FILTER (a > 0) AS mean_risk, stddev_pop(e / a) FILTER (a > 0) AS std_risk, min(e / a) FILTER (a > 0) AS min_risk, max(e / a) FILTER (a > 0) AS max_risk FROM g GROUP BY form) SELECT form, rows, accepted, rows - accepted AS refused, errors, groups_with_acceptance, CASE WHEN rows > accepted THEN 'refused_empirical_support_disagreement=' || (rows - accepted) ELSE '' END AS refusals, round(accepted / rows, 6) AS coverage, round(CASE WHEN accepted > 0 THEN errors / accepted END, 6) AS risk, round(mean_risk, 6) AS mean_risk, round(std_risk, 6) AS std_risk, round(min_risk, 6) AS min_risk, round(max_risk, 6) AS max_risk FROM h",
    "ordered_commitments": _D + " SELECT repository, sha256(string_agg(doc_id || '|' || lang || '|' || n_chars || chr(10), '' ORDER BY doc_id)) AS commitment, count(*) AS n FROM d GROUP BY 1",
    "sequence_hashes": _D + " SELECT repository, sha256('[' || string_agg('\"key-' || doc_id || '\"', ',' ORDER BY doc_id) || ']') AS sha256, count(*) AS n FROM d GROUP BY 1",
    "allocation_counts": _REPO + " SELECT role, sum(row_count)::BIGINT AS row_count, 0::BIGINT AS repeated, sha256(string_agg(repository || chr(10), '' ORDER BY repository)) AS commitment, count(*) AS n FROM r GROUP BY role",
    "fold_splits": "WITH k AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('split|' || vec_id), vec_id) AS rk, count(*) OVER () AS n FROM embeddings) SELECT vec_id, CASE WHEN rk <= n * 6 // 10 THEN 'train' WHEN rk <= n * 8 // 10 THEN 'validation' ELSE 'test' END AS split FROM k",
    "signed_margins": f"WITH {_PRIM} SELECT doc_id, p1 AS m0, p2 AS m1, p3 AS m2, least(p1, p2, p3) > 0 AS all_positive FROM z0",
    "quantile_groups": "WITH g AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT source, n, round(percent_rank() OVER (ORDER BY n), 6) AS place FROM g",
}
for _name in ("repository_names", "name_family_report", "owner_role_groups", "owner_role_analysis", "role_disjointness", "fit_calibration_split", "minimum_support", "largest_repositories", "near_duplicate_report", "near_duplicate_buckets", "near_pair_labels", "near_pair_degrees", "ordered_commitments", "sequence_hashes", "allocation_counts"):
    ORACLES[_name] = "WITH " + ORACLES[_name]
ORACLES["manifest_checks"] = f"SELECT q, count(*) AS pairs, min(pair_order) = 0 AND max(pair_order) = count(*) - 1 AND count(DISTINCT pair_order) = count(*) AS contiguous, count(*) FILTER (selection_sha256 <> sha256('seed-17' || chr(10) || q || chr(10) || closer || chr(10) || farther)) AS wrong_digests FROM ({_BEFORE['hard_negative_pairs']}) GROUP BY q"
ORACLES["component_commitments"] = f"""SELECT component, sha256('{{"members":[' || string_agg('"' || node || '"', ',' ORDER BY node) || '],"protocol_sha256":"protocol-1"}}') AS component_id, count(*)::INT AS size FROM ({_BEFORE['components']}) GROUP BY component"""
ORACLES["near_pair_classes"] = "WITH " + _HASH.format(source="documents") + """, p AS (SELECT doc_id, source, lang, sha256(text) AS h, f FROM documents JOIN f USING (doc_id))
SELECT CASE WHEN a.h = b.h THEN 'exact' WHEN a.f = b.f THEN 'same_fingerprint' WHEN a.lang = b.lang THEN 'near_same_language' ELSE 'near_cross_language' END AS kind, bit_count(xor(a.f, b.f))::INT AS distance, count(*) AS pairs
FROM p a JOIN p b ON a.doc_id < b.doc_id AND a.source <> b.source AND bit_count(xor(a.f, b.f)) <= 3 GROUP BY ALL"""

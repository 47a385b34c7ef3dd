"""Registered queries of operators that are designs only, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintmill.operators import copies as N
from lintmill.operators import designs as D
from lintmill.operators import evidence as E
from lintmill.operators import findings as O
from lintmill.operators import graph as G
from lintmill.plans import sql as Q
from lintmill.plans.queries import _ROOTS, _walk, classified, query, roots
from lintmill.sources.store import written
from lintmill.sources.tables import edges, table


def _node(spark, name):
    return spark.createDataFrame([(name,)], "id string")


_ONE = "SELECT '{0}' AS root, '{0}' AS id, 0 AS hops"


def _both(start: str, hops: int) -> str:
    """Tables ed, fwd and bwd (root, id, hops)."""
    steps = "SELECT DISTINCT src AS a, dst AS b FROM ed WHERE kind = 'CALLS' AND confidence >= 0.6::DOUBLE"
    walk = "{0}w(root, id, hops) AS ({1} UNION ALL SELECT DISTINCT root, st.{3}, hops + 1 FROM {0}w JOIN st ON st.{2} = {0}w.id WHERE hops < {4})"
    return f"WITH RECURSIVE {Q.EDGES}, st AS ({steps}), {walk.format('f', start, 'a', 'b', hops)}, {walk.format('b', start, 'b', 'a', hops)}"


_NEAR = _both(_ONE.format("fn:7"), 2) + """, nb AS (SELECT root, id, min(hops) AS hops FROM (SELECT * FROM (SELECT root, id, min(hops) AS hops FROM fw GROUP BY ALL) UNION ALL SELECT * FROM (SELECT root, id, min(hops) AS hops FROM bw GROUP BY ALL)) WHERE hops > 0 GROUP BY root, id),
un AS (SELECT root AS grp, id, CAST(substr(id, 4) AS BIGINT) AS seq, 10 - hops AS priority, 100 + CAST(substr(id, 4) AS BIGINT) % 7 * 50 AS t FROM nb),
pg AS (SELECT grp, list({'t': t, 'id': id} ORDER BY priority DESC, seq) AS u FROM un GROUP BY grp),
pk AS (SELECT grp, len(u) AS n, list_reduce(list_transform(u, lambda x: {'t': x.t, 'ids': [x.id], 'used': 0::BIGINT}),
  lambda a, x: CASE WHEN a.used + x.t <= 2000 THEN {'t': 0::BIGINT, 'ids': a.ids || x.ids, 'used': a.used + x.t} ELSE a END, {'t': 0::BIGINT, 'ids': []::VARCHAR[], 'used': 0::BIGINT}) AS r FROM pg)"""


@query("dsg01_neighbourhood", _NEAR + " SELECT grp, r.used AS tokens, CAST(n - len(r.ids) AS INT) AS dropped, array_to_string(r.ids, ',') AS ids FROM pk")
def dsg01_neighbourhood(spark, sf_dir):
    """DSG01: callers and callees of a function within two hops, the nearest first, cut to a token budget."""
    near = D.neighbourhood(edges(spark, sf_dir), _node(spark, "fn:7"), "CALLS", 2, 0.6)
    seq = F.substring("id", 4, 20).cast("bigint")
    units = near.select(F.col("root").alias("grp"), "id", seq.alias("seq"), (10 - F.col("hops")).alias("priority"), (100 + seq % 7 * 50).alias("tokens"), F.lit("").alias("text"))
    packed = E.packed(units, 2000)
    return packed.groupBy("grp", "tokens", "dropped").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",").alias("ids"))


@query("dsg05_impact", f"""WITH RECURSIVE {Q.EDGES}, sc AS (SELECT DISTINCT src, dst FROM ed WHERE kind = 'CALLS' AND confidence >= 0.5::DOUBLE),
cw(id, hops) AS (SELECT * FROM (VALUES ('fn:3', 0), ('field:7', 0)) v UNION ALL SELECT DISTINCT sc.src, hops + 1 FROM cw JOIN sc ON sc.dst = cw.id WHERE hops < 2)
SELECT id, kind, CAST(min(hops) AS INT) AS hops FROM (SELECT id, 'CALLS' AS kind, hops FROM cw WHERE hops > 0 AND id NOT IN ('fn:3', 'field:7')
  UNION ALL SELECT src, kind, 1 FROM ed WHERE kind IN ('READS', 'WRITES') AND confidence >= 0.5::DOUBLE AND dst IN ('fn:3', 'field:7')) GROUP BY id, kind""")  # fmt: skip
def dsg05_impact(spark, sf_dir):
    """DSG05: what a change of a function and a field can reach backwards, by kind of edge."""
    changed = spark.createDataFrame([("fn:3",), ("field:7",)], "id string")
    return D.impact(edges(spark, sf_dir), changed, {"CALLS": 2, "READS": 1, "WRITES": 1}, 0.5)


@query("dsg06_access_gaps", """WITH rq AS (SELECT DISTINCT 'g' || (o_custkey % 20) AS grp, 'r' || (o_orderkey % 40) AS resource, o_orderstatus AS verb FROM orders),
gr AS (SELECT DISTINCT 'g' || (l_suppkey % 20) AS grp, 'r' || (l_partkey % 50) AS resource, l_linestatus AS verb FROM lineitem)
SELECT grp, resource, verb, CASE WHEN gr.grp IS NULL THEN 'missing' WHEN rq.grp IS NULL THEN 'unused' ELSE 'ok' END AS state FROM rq FULL JOIN gr USING (grp, resource, verb)""")
def dsg06_access_gaps(spark, sf_dir):
    """DSG06: required against granted rights."""
    name = lambda prefix, c, m: F.concat(F.lit(prefix), (F.col(c) % m).cast("string"))
    required = table(spark, sf_dir, "orders").select(name("g", "o_custkey", 20).alias("grp"), name("r", "o_orderkey", 40).alias("resource"), F.col("o_orderstatus").alias("verb"))
    granted = table(spark, sf_dir, "lineitem").select(name("g", "l_suppkey", 20).alias("grp"), name("r", "l_partkey", 50).alias("resource"), F.col("l_linestatus").alias("verb"))
    return D.access_gaps(required, granted, ("grp", "resource", "verb"))


@query("dsg07_tests_reaching", _walk("SELECT 'fn:3', 'fn:3', 0", 2, "dst", "src") + " SELECT root, id, CAST(hops AS INT) AS hops FROM rc WHERE hops > 0 AND CAST(substr(id, 4) AS INT) % 10 = 1")
def dsg07_tests_reaching(spark, sf_dir):
    """DSG07: the tests among a function's callers."""
    tests = spark.range(50).select(F.concat(F.lit("fn:"), (F.col("id") * 10 + 1).cast("string")).alias("id"))
    return G.reachable(edges(spark, sf_dir), _node(spark, "fn:3"), "CALLS", 2, 0.60, reverse=True).join(tests, "id", "left_semi").select("root", "id", "hops")


@query("dsg08_deployments", """SELECT 'part:' || (l_partkey % 100) AS source, 'region:' || n_regionkey AS target, count(*) AS paths
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def dsg08_deployments(spark, sf_dir):
    """DSG08: what is built, deployed and run, as a chain of joins; the number of paths from each source to each target."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    built = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().select(text("part:", F.col("l_partkey") % 100).alias("src"), text("s:", F.col("l_suppkey")).alias("dst"))
    deployed = table(spark, sf_dir, "supplier").select(text("s:", F.col("s_suppkey")).alias("src"), text("n:", F.col("s_nationkey")).alias("dst"))
    run = table(spark, sf_dir, "nation").select(text("n:", F.col("n_nationkey")).alias("src"), text("region:", F.col("n_regionkey")).alias("dst"))
    return D.chained(built, deployed, run)


@query("dsg09_ranking_features", _walk(_ROOTS, 3) + """, ca AS (SELECT DISTINCT src, dst FROM ed WHERE kind = 'CALLS'), ids AS (SELECT src AS id FROM ca UNION SELECT dst FROM ca UNION SELECT src FROM ed WHERE kind <> 'CALLS')
SELECT id, (SELECT count(*) FROM ca WHERE dst = id) AS fan_in, (SELECT count(*) FROM ca WHERE src = id) AS fan_out, (SELECT count(*) FROM ed WHERE kind <> 'CALLS' AND src = id) AS accesses,
  CAST((SELECT min(hops) FROM rc WHERE rc.id = ids.id AND hops > 0) AS INT) AS entry_distance FROM ids""")
def dsg09_ranking_features(spark, sf_dir):
    """DSG09: fan-in, fan-out, accesses and distance from an entry, per function."""
    return D.ranking_features(edges(spark, sf_dir), roots(spark), "CALLS", 3, 0.60)


@query("dsg09_centrality", f"""WITH RECURSIVE {Q.EDGES}, ca AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS part FROM (SELECT DISTINCT src, dst FROM ed WHERE kind = 'CALLS')),
nd AS (SELECT id, count(*) OVER () AS n FROM (SELECT src AS id FROM ed UNION SELECT dst FROM ed)),
w(i, id, c) AS (SELECT 0, id, 1.0::DOUBLE / n FROM nd UNION ALL
  SELECT i, id, 0.15::DOUBLE / n + 0.85::DOUBLE * (a + (1 - sum(a) OVER ()) / n) FROM (
    SELECT (SELECT max(i) + 1 FROM w) AS i, nd.id, n, coalesce(a, 0) AS a FROM nd LEFT JOIN (SELECT dst AS id, sum(c * part) AS a FROM w JOIN ca ON ca.src = w.id GROUP BY dst) USING (id)) WHERE i <= 250)
SELECT id, round(c, 9) AS centrality FROM w WHERE i = 250""")  # fmt: skip
def dsg09_centrality(spark, sf_dir):
    """DSG09: centrality of functions and fields by their calls, as the fixed point of a random walk."""
    return G.centrality(edges(spark, sf_dir), "CALLS").select("id", F.round("centrality", 9).alias("centrality"))


@query("dsg09_exposure", _walk(_ROOTS, 3) + """, wt(root, id, hops) AS (SELECT 'fn:' || (i * 10 + 1), 'fn:' || (i * 10 + 1), 0 FROM range(50) t(i) UNION ALL SELECT DISTINCT root, b, hops + 1 FROM wt JOIN st ON st.a = wt.id WHERE hops < 3),
tc AS (SELECT root, id FROM wt GROUP BY root, id HAVING min(hops) > 0), nd AS (SELECT src AS id FROM ed WHERE kind = 'CALLS' UNION SELECT dst FROM ed WHERE kind = 'CALLS'),
x AS (SELECT id, (SELECT count(*) FROM rc WHERE rc.id = nd.id AND hops > 0) AS entries, (SELECT count(*) FROM tc WHERE tc.id = nd.id) AS tests FROM nd)
SELECT *, entries > 0 AS exposed, tests > 0 AS covered FROM x""")
def dsg09_exposure(spark, sf_dir):
    """DSG09: functions that an entry reaches, and those that a test reaches."""
    tests = spark.range(50).select(F.concat(F.lit("fn:"), (F.col("id") * 10 + 1).cast("string")).alias("id"))
    return D.exposure(edges(spark, sf_dir), roots(spark), tests, "CALLS", 3, 0.60)


_AS_OF, _HALF_LIFE = "1998-12-31", 180.0


@query("dsg09_history", f"""WITH c AS (SELECT 'part:' || l_partkey AS id, l_suppkey AS owner, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{_AS_OF}')
SELECT id, count(*) AS changes, round(sum(pow(0.5::DOUBLE, (DATE '{_AS_OF}' - day) / {_HALF_LIFE}::DOUBLE)), 6) AS churn, CAST(DATE '{_AS_OF}' - min(day) AS INT) AS age_days, CAST(DATE '{_AS_OF}' - max(day) AS INT) AS idle_days, count(DISTINCT owner) AS owners FROM c GROUP BY id""")
def dsg09_history(spark, sf_dir):
    """DSG09: churn, age and owners of every part, from two tables of its changes that were counted at different times and put together."""
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_suppkey").alias("owner"), F.col("l_shipdate").alias("at"))
    then = F.col("at").cast("date") <= F.lit("1995-06-30").cast("date")
    tables = D.history(t.where(then), "1995-06-30", _HALF_LIFE).unionByName(D.history(t.where(~then), _AS_OF, _HALF_LIFE))
    return D.history_features(D.merged_history(tables, _AS_OF, _HALF_LIFE)).select("id", "changes", F.round("churn", 6).alias("churn"), "age_days", "idle_days", "owners")


@query("dsg10_guards", f"""WITH {Q.EDGES}, ac AS (SELECT dst, locks FROM ed WHERE kind <> 'CALLS')
SELECT DISTINCT l.lock, a.dst AS field FROM ac a, unnest(a.locks) l(lock) WHERE NOT EXISTS (SELECT 1 FROM ac o WHERE o.dst = a.dst AND NOT list_contains(o.locks, l.lock))""")
def dsg10_guards(spark, sf_dir):
    """DSG10: inferred edges from a lock to the fields that it guards."""
    return D.guards(G.of_kind(edges(spark, sf_dir), "READS", "WRITES"))


# Which edges a category's context follows.
RECIPES = (("CONC.MISUSE", "READS"), ("CONC.MISUSE", "WRITES"), ("CTX.PROPAGATION", "CALLS"), ("CORRECTNESS", "CALLS"), ("API.MISUSE", "CALLS"), ("UNCATEGORIZED", "CALLS"))
_FUNCTION = "'fn:' || ((line * 10 + col) % 500)"


def _in_functions(findings):
    return findings.withColumn("function", F.concat(F.lit("fn:"), ((F.col("line") * 10 + F.col("col")) % 500).cast("string")))


@query("dsg12_recipes", f"""WITH {Q.CLASSIFIED}, {Q.EDGES}, rp AS (SELECT * FROM (VALUES {', '.join(str(r) for r in RECIPES)}) v(category, kind)),
fd AS (SELECT DISTINCT category, {_FUNCTION} AS function FROM cl WHERE suppress_reason = '')
SELECT fd.category, fd.function, e.kind, count(DISTINCT e.dst) AS nodes FROM fd JOIN rp USING (category) JOIN ed e ON e.src = fd.function AND e.kind = rp.kind GROUP BY ALL""")  # fmt: skip
def dsg12_recipes(spark, sf_dir):
    """DSG12: the context that a finding's category asks for, per function."""
    places = _in_functions(O.kept(classified(spark, sf_dir))).select("category", "function").distinct()
    recipes = spark.createDataFrame(list(RECIPES), "category string, kind string")
    return D.recipe_context(places, recipes, edges(spark, sf_dir)).groupBy("category", "function", "kind").agg(F.count("*").alias("nodes"))


@query("dsg14_split_recall", """WITH rq AS (SELECT doc_id // 50 AS grp, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'single' ELSE 'cross' END AS files, n_chars // 4 AS tokens, doc_id % 3 <> 0 AS found FROM documents WHERE doc_id % 7 = 0)
SELECT files, count(*) AS required, avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall, CAST(sum(CASE WHEN found THEN tokens ELSE 0 END) AS BIGINT) AS tokens FROM rq GROUP BY files""")
def dsg14_split_recall(spark, sf_dir):
    """DSG14: recall and tokens of what was found, for single-file and cross-file needs apart."""
    d = F.col("doc_id")
    need = table(spark, sf_dir, "documents").where(d % 7 == 0).select(F.when(d % 2 == 0, "single").otherwise("cross").alias("files"), F.floor(F.col("n_chars") / 4).alias("tokens"), (d % 3 != 0).alias("found"))
    return need.groupBy("files").agg(F.count("*").alias("required"), F.avg(F.when(F.col("found"), 1.0).otherwise(0.0)).alias("recall"), F.sum(F.when(F.col("found"), F.col("tokens")).otherwise(0)).alias("tokens"))


@query("dsg15_splits", """WITH l AS (SELECT o_custkey, max(o_orderdate) AS latest, bool_or(o_custkey % 11 = 0) AS held FROM orders GROUP BY o_custkey)
SELECT o_orderkey, CASE WHEN held THEN 'test' WHEN latest < DATE '1997-06-01' THEN 'train' WHEN latest < DATE '1998-03-01' THEN 'validation' ELSE 'test' END AS split FROM orders JOIN l USING (o_custkey)""")
def dsg15_splits(spark, sf_dir):
    """DSG15: splits by time that keep pairs together, with held-out repositories; ``dsg15_clean_splits`` removes near copies first."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return D.splits(rows, "o_orderdate", "o_custkey", F.col("o_custkey") % 11 == 0, "1997-06-01", "1998-03-01").select("o_orderkey", "split")


_COPIES = """WITH RECURSIVE cw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
cs AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM cw)),
cn AS (SELECT doc_id, count(*) AS n FROM cs GROUP BY doc_id),
cp AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM cs x JOIN cs y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p JOIN cn u ON u.doc_id = a JOIN cn v ON v.doc_id = b WHERE 180 * p.n >= 80 * (u.n + v.n)),
cb AS (SELECT a, b FROM cp UNION ALL SELECT b, a FROM cp),
cr(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT cr.id, cb.b FROM cr JOIN cb ON cb.a = cr.other),
cm AS (SELECT id AS doc_id, min(other) AS representative FROM cr GROUP BY id)"""


@query("dsg15_near_copies", f"{_COPIES} SELECT doc_id, representative FROM cm")
def dsg15_near_copies(spark, sf_dir):
    """DSG15: the document that stands for each one's group of near copies, by buckets of signatures and exact comparison."""
    return N.near_copies(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "representative")


@query("dsg15_clean_splits", f"""{_COPIES}, cg AS (SELECT representative, max(doc_id) AS latest, bool_or(source IN ('src3', 'src7')) AS held FROM documents JOIN cm USING (doc_id) GROUP BY representative), ct AS (SELECT max(doc_id) + 1 AS n FROM documents)
SELECT representative AS doc_id, CASE WHEN held THEN 'test' WHEN latest * 10 < n * 8 THEN 'train' WHEN latest * 10 < n * 9 THEN 'validation' ELSE 'test' END AS split FROM cg, ct""")
def dsg15_clean_splits(spark, sf_dir):
    """DSG15: one document of each group of near copies with its split: by the latest of the group, ids in place of dates, and held-out sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    copies = written(N.near_copies(table(spark, sf_dir, "documents")), "copies")
    n = docs.agg(F.max("doc_id") + 1).first()[0] or 0
    grouped = docs.join(copies.withColumnRenamed("id", "doc_id"), "doc_id")
    out = D.splits(grouped, "doc_id", "representative", F.col("source").isin("src3", "src7"), -(-n * 8 // 10), -(-n * 9 // 10))
    return N.without_copies(out, copies).select("doc_id", "split")


@query("dsg16_label_mix", """WITH e AS (SELECT source, doc_id, quality = 0 AS negative FROM labels JOIN documents USING (doc_id)), c AS (SELECT source, floor(count(*) FILTER (negative) * 1.5::DOUBLE) AS most FROM e GROUP BY source),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('7' || doc_id), doc_id) AS n FROM e WHERE NOT negative)
SELECT source, doc_id, negative FROM n JOIN c USING (source) WHERE n <= most UNION ALL SELECT source, doc_id, negative FROM e WHERE negative""")
def dsg16_label_mix(spark, sf_dir):
    """DSG16: hard negatives are two fifths of each source's examples at least."""
    e = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", "doc_id", (F.col("quality") == 0).alias("negative"))
    return D.label_mix(e, F.col("negative"), 2, 5, (F.sha2(F.concat(F.lit("7"), F.col("doc_id").cast("string")), 256), "doc_id"))


@query("dsg17_weighted_rate", """WITH v AS (SELECT source, lang AS grp, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)), w AS (SELECT source, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS weight FROM v GROUP BY source HAVING weight >= 0.3::DOUBLE)
SELECT grp, count(*) AS n, round(sum(weight * a) / sum(weight), 9) AS rate FROM v JOIN w USING (source) GROUP BY grp""")
def dsg17_weighted_rate(spark, sf_dir):
    """DSG17: labels weighted by how far their source's two judges agree."""
    votes = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").select("source", F.col("lang").alias("grp"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return D.weighted_rate(votes, 0.3).select("grp", "n", F.round("rate", 9).alias("rate"))


_FILES_NOW = "SELECT 'fn:' || doc_id AS id, sha256(coalesce(text, '') || CASE WHEN doc_id % 97 = 3 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 89 <> 5"


@query("dsg23_reindex", f"""WITH RECURSIVE {Q.EDGES}, st AS (SELECT DISTINCT src, dst FROM ed WHERE kind = 'CALLS' AND confidence >= 0.75::DOUBLE), bf AS (SELECT 'fn:' || doc_id AS id, sha256(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 83 <> 7), af AS ({_FILES_NOW}),
ch AS (SELECT id FROM bf FULL JOIN af USING (id) WHERE bf.hash IS DISTINCT FROM af.hash),
w(id, hops) AS (SELECT id, 0 FROM ch UNION ALL SELECT DISTINCT st.src, hops + 1 FROM w JOIN st ON st.dst = w.id WHERE hops < 2)
SELECT id, CAST(min(hops) AS INT) AS hops FROM w GROUP BY id""")  # fmt: skip
def dsg23_reindex(spark, sf_dir):
    """DSG23: files that changed, came or went, and the functions that depend on them."""
    d = table(spark, sf_dir, "documents")
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    name = F.concat(F.lit("fn:"), i.cast("string")).alias("id")
    before = d.where(i % 83 != 7).select(name, F.sha2(text, 256).alias("hash"))
    after = d.where(i % 89 != 5).select(name, F.sha2(F.concat(text, F.when(i % 97 == 3, "!").otherwise("")), 256).alias("hash"))
    return D.reindex(before, after, edges(spark, sf_dir), 2, 0.75)


@query("dsg24_supported", f"""WITH {Q.CLASSIFIED}, {Q.EDGES}, fa AS (SELECT src, bool_or(producer <> 'model') AS fact FROM ed GROUP BY src)
SELECT repo, side, fingerprint, line, col, priority, priority NOT IN ('high', 'critical') OR coalesce(fact, FALSE) AS supported FROM cl LEFT JOIN fa ON fa.src = {_FUNCTION} WHERE suppress_reason = ''""")  # fmt: skip
def dsg24_supported(spark, sf_dir):
    """DSG24: findings of high severity need an edge that no model made."""
    return D.supported(_in_functions(O.kept(classified(spark, sf_dir))), edges(spark, sf_dir)).select("repo", "side", "fingerprint", "line", "col", "priority", "supported")


@query("dsg25_retrieval_pairs", f"""WITH {Q.CLASSIFIED}, k AS (SELECT * FROM cl WHERE suppress_reason = ''), fx AS (SELECT DISTINCT repo, fingerprint, doc_id FROM k WHERE side = 'base' AND NOT EXISTS (SELECT 1 FROM k o WHERE o.side = 'head' AND o.repo = k.repo AND o.fingerprint = k.fingerprint))
SELECT repo, fingerprint, 'doc:' || d.doc_id AS unit FROM fx JOIN documents d ON d.doc_id = fx.doc_id OR d.doc_id = fx.doc_id + 1""")  # fmt: skip
def dsg25_retrieval_pairs(spark, sf_dir):
    """DSG25: fixed findings with the context units that the fix touched, here the file and the one after it."""
    f = O.kept(classified(spark, sf_dir))
    fixed = O.absent(f.where("side = 'base'"), f.where("side = 'head'")).select("repo", "fingerprint", "doc_id").distinct()
    d = table(spark, sf_dir, "documents").select("doc_id")
    unit = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("unit")
    touched = d.select("doc_id", unit).union(d.select((F.col("doc_id") - 1).alias("doc_id"), unit))
    return D.retrieval_pairs(fixed, touched).select("repo", "fingerprint", "unit")


@query("dsg26_serving_cost", "SELECT n_nationkey AS service, (n_nationkey + 1) * 100 AS requests, 10 + n_nationkey % 21 AS candidates, (n_nationkey + 1) * 100 * (10 + n_nationkey % 21) * 3.0::DOUBLE AS gpu_seconds, round((n_nationkey + 1) * 100 * (10 + n_nationkey % 21) * 3.0::DOUBLE / 3600.0::DOUBLE * 0.8::DOUBLE, 6) AS price FROM nation")
def dsg26_serving_cost(spark, sf_dir):
    """DSG26: GPU seconds and price of a load, with three seconds per candidate."""
    n = F.col("n_nationkey")
    load = table(spark, sf_dir, "nation").select(n.alias("service"), ((n + 1) * 100).alias("requests"), (10 + n % 21).alias("candidates"))
    return D.serving_cost(load, 3.0, 0.8).withColumn("price", F.round("price", 6))

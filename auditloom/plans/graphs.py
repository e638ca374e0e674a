"""Queries on graphs: neighbourhoods, closures, paths in time, components, incidents and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import graph as G, incidents as I, joins, metrics as M, provenance as P, scoring as A, triage as T, windows
from auditloom.plans.core import edges, nodes, truth
from auditloom.plans.detection import predictions
from auditloom.plans.registry import query

#: Undirected links of the test period, and malicious users as starting points.
LINKS = "l AS (SELECT src AS a, dst AS b FROM e WHERE split = 'test' UNION SELECT dst, src FROM e WHERE split = 'test'), st AS (SELECT DISTINCT src AS node FROM e WHERE split = 'test' AND op = 'error' AND loss > 150)"


def test_edges(spark, d):
    return edges(spark, d).where("split = 'test'")


def start(e):
    return e.where("op = 'error' and loss > 150").select(F.col("src").alias("node")).distinct()


@query("neighbourhood", "node:l", f"WITH {{E}}, {LINKS}, h1 AS (SELECT node FROM st UNION SELECT b FROM l JOIN st ON a = node) SELECT node FROM h1 UNION SELECT b FROM l JOIN h1 ON a = node")
def neighbourhood(spark, d):
    """G8."""
    e = test_edges(spark, d)
    return G.neighbourhood(e, start(e), 2)


@query("closure", "root:l n:l", f"WITH RECURSIVE {{E}}, {LINKS}, r AS (SELECT node AS root, node FROM st UNION SELECT root, dst FROM r JOIN e ON e.src = r.node WHERE split = 'test') SELECT root, count(*) AS n FROM r GROUP BY root")
def closure(spark, d):
    """Descendants."""
    e = test_edges(spark, d)
    return G.reach_counts(e, start(e))


@query("ancestors", "root:l n:l", f"WITH RECURSIVE {{E}}, {LINKS}, r AS (SELECT node AS root, node FROM st UNION SELECT root, src FROM r JOIN e ON e.dst = r.node WHERE split = 'test') SELECT root, count(*) AS n FROM r GROUP BY root")
def ancestors(spark, d):
    """G9."""
    e = test_edges(spark, d)
    return G.reach_counts(e, start(e), forward=False)


@query("between_nodes", "node:l", f"""WITH RECURSIVE {{E}}, {LINKS}, dn AS (SELECT node FROM st UNION SELECT dst FROM dn JOIN e ON e.src = dn.node WHERE split = 'test'), x AS (SELECT DISTINCT dst AS node FROM e WHERE split = 'test' AND op = 'view' AND loss > 150),
    up AS (SELECT node FROM x UNION SELECT src FROM up JOIN e ON e.dst = up.node WHERE split = 'test') SELECT node FROM dn INTERSECT SELECT node FROM up""")
def between_nodes(spark, d):
    """G15."""
    e = test_edges(spark, d)
    return G.between_nodes(e, start(e), e.where("op = 'view' and loss > 150").select(F.col("dst").alias("node")))


REACH = """r0 AS (SELECT src AS root, src AS node, min(t) AS t FROM e WHERE split = 'test' AND op = 'error' AND loss > 150 GROUP BY src),
    r1 AS (SELECT root, node, min(t) AS t FROM (SELECT * FROM r0 UNION ALL SELECT root, dst, e.t FROM r0 JOIN e ON e.src = r0.node AND e.t >= r0.t AND split = 'test') GROUP BY root, node),
    r2 AS (SELECT root, node, min(t) AS t FROM (SELECT * FROM r1 UNION ALL SELECT root, dst, e.t FROM r1 JOIN e ON e.src = r1.node AND e.t >= r1.t AND split = 'test') GROUP BY root, node),
    r3 AS (SELECT root, node, min(t) AS t FROM (SELECT * FROM r2 UNION ALL SELECT root, dst, e.t FROM r2 JOIN e ON e.src = r2.node AND e.t >= r2.t AND split = 'test') GROUP BY root, node)"""


def timed_start(e):
    return e.where("op = 'error' and loss > 150").groupBy(F.col("src").alias("node")).agg(F.min("t").alias("t"))


@query("temporal_reach", "root:l node:l t:l", f"WITH {{E}}, {REACH} SELECT * FROM r3")
def temporal_reach(spark, d):
    """G13, G16, G28."""
    e = test_edges(spark, d)
    return G.temporal_reach(e, timed_start(e), 3)


@query("temporal_reach_back", "root:l node:l t:l", f"WITH {{E}}, {REACH.replace('min(t)', 'max(t)').replace('e.src = r', 'e.dst = r').replace('root, dst, e.t', 'root, src, e.t').replace('e.t >=', 'e.t <')} SELECT * FROM r3")
def temporal_reach_back(spark, d):
    """Strictly back in time."""
    e = test_edges(spark, d)
    s = e.where("op = 'error' and loss > 150").groupBy(F.col("src").alias("node")).agg(F.max("t").alias("t"))
    return G.temporal_reach(e, s, 3, forward=False, strict=True)


@query("temporal_paths", "pair:l cost:d hops:l", """WITH {E}, p AS (SELECT event_id AS pair, dst AS start, lead(src) OVER (ORDER BY t, event_id) AS target, t AS lo, lead(t) OVER (ORDER BY t, event_id) + 86400000000000 AS hi FROM e, thr WHERE split = 'test' AND loss >= thr), q AS (SELECT * FROM p WHERE target IS NOT NULL),
    s1 AS (SELECT pair, target, hi, dst AS node, t AS arr, 1 / (1 + loss) AS cost, 1 AS hops FROM q JOIN e ON src = start AND t >= lo AND t <= hi AND split = 'test' AND start <> target),
    s2 AS (SELECT pair, target, hi, dst AS node, t AS arr, cost + 1 / (1 + loss) AS cost, 2 AS hops FROM s1 JOIN e ON src = node AND t >= arr AND t <= hi AND split = 'test' AND node <> target),
    s3 AS (SELECT pair, target, hi, dst AS node, t AS arr, cost + 1 / (1 + loss) AS cost, 3 AS hops FROM s2 JOIN e ON src = node AND t >= arr AND t <= hi AND split = 'test' AND node <> target),
    a AS (SELECT pair, cost, hops FROM s1 WHERE node = target UNION ALL SELECT pair, cost, hops FROM s2 WHERE node = target UNION ALL SELECT pair, cost, hops FROM s3 WHERE node = target UNION ALL SELECT pair, 0, 0 FROM q WHERE start = target)
    SELECT pair, cost, hops FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY cost, hops) AS rn FROM a) WHERE rn = 1""")
def temporal_paths(spark, d):
    """From each seed to the next, within a day of it."""
    from pyspark.sql import Window

    e = edges(spark, d)
    t = e.where("split = 'test'").withColumn("cost", 1 / (1 + F.col("loss")))
    w = Window.orderBy("t", "event_id")
    s = A.seeds(t, A.threshold(e.where("split = 'val'"), "nodlink"))
    pairs = s.select(F.col("event_id").alias("pair"), F.col("dst").alias("start"), F.lead("src").over(w).alias("target"), F.col("t").alias("lo"), (F.lead("t").over(w) + P.DAY).alias("hi")).where("target is not null")
    return G.temporal_paths(t, pairs, 3)


@query("components", "node:l component:l", """WITH RECURSIVE {E}, s AS (SELECT e.* FROM e, thr WHERE split = 'test' AND loss >= thr), l AS (SELECT src AS a, dst AS b FROM s UNION SELECT dst, src FROM s), r AS (SELECT a AS node, a AS root FROM l UNION SELECT b, root FROM r JOIN l ON a = node) SELECT node, min(root) AS component FROM r GROUP BY node""")
def components(spark, d):
    """G19."""
    e = edges(spark, d)
    s = A.seeds(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))
    return G.components(s, "src", "dst")


@query("spanning_trees", "component:l edges:l nodes:l weight:d")
def spanning_trees(spark, d):
    """The tests hold trees and their weights against brute force."""
    e = edges(spark, d)
    s = A.seeds(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))
    c = G.components(s, "src", "dst")
    links = s.join(c, s["src"] == c["node"]).groupBy("component", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(1 / (1 + F.col("loss"))).alias("weight"))
    tree = G.spanning_trees(links)
    n = tree.select("component", F.explode(F.array("a", "b")).alias("node")).groupBy("component").agg(F.countDistinct("node").alias("nodes"))
    return tree.groupBy("component").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")).join(n, "component")


@query("pruned", "a:l b:l", f"""WITH RECURSIVE {{E}}, x AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e, thr WHERE split = 'test' AND loss >= thr), p0 AS (SELECT * FROM x), {", ".join(f"d{i} AS (SELECT node FROM (SELECT a AS node, b AS o FROM p{i} UNION SELECT b, a FROM p{i}) WHERE node NOT IN (SELECT node FROM truth) GROUP BY node HAVING count(DISTINCT o) <= 1), p{i + 1} AS MATERIALIZED (SELECT * FROM p{i} WHERE a NOT IN (SELECT node FROM d{i}) AND b NOT IN (SELECT node FROM d{i}))" for i in range(12))} SELECT * FROM p12""")
def pruned(spark, d):
    """G21."""
    e = edges(spark, d)
    s = A.seeds(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))
    return G.pruned(s.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), truth(e))


@query("acyclic", "src:l dst:l", "WITH {E}, s AS (SELECT DISTINCT src, dst FROM e WHERE split = 'test' AND src <> dst), b AS (SELECT node, min(t) AS t FROM ends WHERE split = 'test' GROUP BY node) SELECT src, dst FROM s JOIN b x ON src = x.node JOIN b y ON dst = y.node WHERE x.t < y.t OR (x.t = y.t AND src < dst)")
def acyclic(spark, d):
    """G3."""
    return G.acyclic(test_edges(spark, d))


@query("first_edges", "w:l src:l dst:l op:s", "WITH {E} SELECT w, src, dst, op FROM (SELECT *, row_number() OVER (PARTITION BY w, src, dst ORDER BY t, event_id) AS rn FROM e) WHERE rn = 1")
def first_edges(spark, d):
    """G6."""
    return G.first_edges(edges(spark, d), "w")


@query("pseudo_roots", "root:l n:l", """WITH RECURSIVE {E}, x AS (SELECT * FROM e, thr WHERE split = 'test' AND loss >= thr), o AS (SELECT src AS node, min(t) AS a FROM x GROUP BY src), i AS (SELECT dst AS node, min(t) AS b FROM x GROUP BY dst), rt AS (SELECT o.node FROM o LEFT JOIN i ON o.node = i.node WHERE b IS NULL OR a < b),
    r AS (SELECT node AS root, node FROM rt UNION SELECT root, dst FROM r JOIN x ON x.src = r.node), k AS (SELECT root, count(*) - 1 AS n FROM r GROUP BY root) SELECT root, n FROM k WHERE n > 0 AND n <= 0.5 * (SELECT count(DISTINCT node) FROM (SELECT src AS node FROM x UNION SELECT dst FROM x))""")
def pseudo_roots(spark, d):
    """G4."""
    e = edges(spark, d)
    s = A.seeds(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))
    return G.pseudo_root_sizes(s, windows.roots(s))


@query("degree_ratios", "node:l ratio:d", "WITH {E} SELECT node, coalesce(sum(CASE WHEN src = node THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN dst = node THEN 1 ELSE 0 END), 0), 0) AS ratio FROM ends WHERE split = 'test' GROUP BY node")
def degree_ratios(spark, d):
    """G11."""
    return G.degree_ratio(test_edges(spark, d))


@query("importance", "node:l importance:d", "WITH {E} SELECT n.node, coalesce(sum(CASE WHEN src = n.node THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN dst = n.node THEN 1 ELSE 0 END), 0), 0) * any_value(score) AS importance FROM ends n JOIN pred ON n.node = pred.node WHERE split = 'test' GROUP BY n.node")
def importance(spark, d):
    """G12."""
    return T.importance(test_edges(spark, d), predictions(spark, d), "degree_recon")


@query("traced", "poi:l node:l")
def traced(spark, d):
    """Over seeds of the test period."""
    e = edges(spark, d)
    s = A.seeds(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))
    return T.trace(s, predictions(spark, d).where("y_hat = 1 and y = 1").select("node"), predictions(spark, d), "shortest_path", "degree_recon")


@query("reevaluated", "tp:l fp:l fn:l tn:l", "WITH {E}, x AS (SELECT * FROM e, thr WHERE split = 'test' AND loss >= thr), l AS (SELECT src AS a, dst AS b FROM x UNION SELECT dst, src FROM x), p AS (SELECT node FROM pred WHERE y_hat = 1 AND y = 1), h1 AS (SELECT node FROM p UNION SELECT b FROM l JOIN p ON a = node), c AS (SELECT y, CASE WHEN node IN (SELECT node FROM h1) THEN 1 ELSE 0 END AS g FROM pred) SELECT count(CASE WHEN y = 1 AND g = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND g = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND g = 0 THEN 1 END) AS fn, count(CASE WHEN y = 0 AND g = 0 THEN 1 END) AS tn FROM c")
def reevaluated(spark, d):
    """Nodes of neighbourhoods that are traced count as predicted."""
    e = edges(spark, d)
    s = A.seeds(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))
    p = predictions(spark, d)
    return M.confusion(T.reevaluated(p, T.trace(s, p.where("y_hat = 1 and y = 1").select("node"), method="k_hop", hops=1)))


@query("window_transfer", "w:l y:l y_hat:l", "WITH {E} SELECT w, max(y) AS y, max(y_hat) AS y_hat FROM ends JOIN pred ON ends.node = pred.node WHERE split = 'test' GROUP BY w")
def window_transfer(spark, d):
    """E25."""
    return T.to_windows(predictions(spark, d), test_edges(spark, d))


@query("fused_nodes", "src_name:s dst_name:s loss:d n:l", "WITH {E} SELECT CASE WHEN src >= 1000000 THEN 'file|' || (src % 10) ELSE 'subject|' || (src % 10) END AS src_name, CASE WHEN dst >= 1000000 THEN 'file|' || (dst % 10) ELSE 'subject|' || (dst % 10) END AS dst_name, max(loss) AS loss, count(*) AS n FROM e GROUP BY 1, 2")
def fused_nodes(spark, d):
    """Paths are made from the last digit."""
    e = edges(spark, d)
    return G.fused_nodes(e, nodes(e).select("node", (F.col("node") % 10).cast("string").alias("path"), "type"))


@query("local_ids", "w:l node:l local:l", "WITH {E} SELECT w, node, row_number() OVER (PARTITION BY w ORDER BY node) - 1 AS local FROM (SELECT DISTINCT w, node FROM ends WHERE split = 'test')")
def local_ids(spark, d):
    """G31."""
    return G.local_ids(test_edges(spark, d), "w")


@query("random_walks", "walk:l n:l last:l")
def random_walks(spark, d):
    """G26, G27, O11."""
    e = test_edges(spark, d)
    s = timed_start(e).select(F.col("node").alias("walk"), "node", "t")
    return G.walks(e, s, 4).select("walk", F.size("nodes").alias("n"), F.element_at("nodes", -1).alias("last"))


@query("temporal_walks", "walk:l n:l first:l last:l")
def temporal_walks(spark, d):
    """From all nodes of the test period, with a half-life of an hour."""
    e = test_edges(spark, d)
    s = P.endpoints(e).distinct().select(F.col("node").alias("walk"), "node")
    return G.temporal_walks(e, s, 5, P.HOUR).select("walk", F.size("nodes").alias("n"), F.element_at("nodes", 1).alias("first"), F.element_at("nodes", -1).alias("last"))


@query("node_view", "event_id:l other:l label:s", "WITH {E} SELECT event_id, other, CASE WHEN other >= 1000000 THEN '/data/d' || (other % 7) || '/f' || other ELSE '/usr/bin/u' || other END AS label FROM ends WHERE node = 1000005")
def node_view(spark, d):
    """V1, V2, J16."""
    e = edges(spark, d)
    return T.node_view(e, nodes(e).select("node", "label"), 1_000_005)


@query("url_search", "node:l url:s capped:b", "WITH f AS (SELECT page_id AS node, url FROM pages WHERE contains(lower(url), 'example.com') OR contains(lower(url), '/de/')) SELECT node, url, (SELECT count(*) FROM f) > 50 AS capped FROM f ORDER BY node LIMIT 50")
def url_search(spark, d):
    """V3: a limit is part of the request."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("node"), "url")
    return T.search(pages, F.col("url"), ["Example.com", "/DE/"], 50)


@query("attack_pairs", "a:l b:l", "WITH {E} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src IN (SELECT node FROM truth) AND dst IN (SELECT node FROM truth) AND src <> dst")
def attack_pairs(spark, d):
    """V5, J17."""
    e = edges(spark, d)
    return T.attack_pairs(e, truth(e))


@query("causal", "root:l node:l direction:s", f"WITH {{E}}, {REACH.replace('r3 AS', 'f3 AS')}, {REACH.replace('min(t)', 'max(t)').replace('e.src = r', 'e.dst = r').replace('root, dst, e.t', 'root, src, e.t').replace('e.t >=', 'e.t <=').replace('r0', 'b0').replace('r1', 'b1').replace('r2', 'b2').replace('r3', 'b3').replace('SELECT src AS root, src AS node, max(t) AS t', 'SELECT src AS root, src AS node, min(t) AS t')} SELECT root, node, 'forward' AS direction FROM f3 UNION ALL SELECT root, node, 'backward' FROM b3")
def causal(spark, d):
    """V4, G28."""
    e = test_edges(spark, d)
    return T.causal(e, timed_start(e), 3)


@query("campaign", "node:l hop:l")
def campaign(spark, d):
    """V6, G29."""
    e = test_edges(spark, d)
    return T.campaign(e, truth(e))


@query("campaign_edges", "src:l dst:l op:s hop:l")
def campaign_edges(spark, d):
    """The edges between the nodes, without cycles."""
    e = test_edges(spark, d)
    return T.campaign_edges(e, truth(e))


@query("time_slice", "event_id:l", f"WITH {{E}}, s AS (SELECT * FROM e WHERE t BETWEEN 1706400000000000000 AND 1706572800000000000), l AS (SELECT src AS a, dst AS b FROM s UNION SELECT dst, src FROM s), st AS (SELECT node FROM truth), h AS (SELECT node FROM st UNION SELECT b FROM l JOIN st ON a = node) SELECT event_id FROM s WHERE src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)")
def time_slice(spark, d):
    """G32, V8."""
    e = edges(spark, d)
    return T.slice_of(e, truth(e).select("node"), 1706400000000000000, 1706572800000000000, 1)


@query("score_histogram", "bin:l n:l", "WITH {E}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM pred) SELECT least(floor((score - lo) / (hi - lo) * 20), 19) AS bin, count(*) AS n FROM pred, m GROUP BY 1")
def score_histogram(spark, d):
    """V7."""
    return T.score_histogram(predictions(spark, d))


@query("smart_sample", "y:l n:l", "WITH {E} SELECT y, CASE WHEN y = 1 THEN count(*) ELSE least(count(*), 30) END AS n FROM pred GROUP BY y")
def smart_sample(spark, d):
    """A sampling operator; how many of each kind it takes."""
    return T.smart_sample(predictions(spark, d), test_edges(spark, d), 30).groupBy("y").agg(F.count("*").alias("n"))


@query("distinct_edges", "src:l dst:l op:s n:l", "WITH {E} SELECT src, dst, op, count(*) AS n FROM e GROUP BY ALL")
def distinct_edges(spark, d):
    """O7."""
    return edges(spark, d).groupBy("src", "dst", "op").agg(F.count("*").alias("n"))


@query("distinct_vectors", "vec_id:l first:l", "WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings) SELECT vec_id, min(vec_id) OVER (PARTITION BY v) AS first FROM r")
def distinct_vectors(spark, d):
    """O8."""
    return T.distinct_vectors(spark.read.parquet(f"{d}/embeddings.parquet"))


@query("anomaly_subgraphs", "seed:l events:l score:d severity:s")
def anomaly_subgraphs(spark, d):
    """G24, O6, F21."""
    e = test_edges(spark, d)
    p = predictions(spark, d).where("y_hat = 1").withColumn("type", F.when(F.col("node") >= 1_000_000, "file").otherwise("subject"))
    sub = T.anomaly_subgraphs(e, p.select("node", "type", "score"))
    return T.severities(sub, e).join(sub.groupBy("seed").agg(F.count("*").alias("events")), "seed")


def incident_rows(spark, d):
    e = edges(spark, d).where("split <> 'train'")
    day = e.withColumn("w", F.floor(F.col("w") / 24))
    at = A.seed_threshold(e.where("split = 'val'"), "percentile", 99)
    config = I.IncidentConfig(max_gap=6 * P.HOUR, max_hops=2, max_context_edges=20, penalties={"view": 0.5})
    test = day.where("split = 'test'")
    return I.build_incidents(test, at, config), test


@query("incident_seeds", "event_id:l", "WITH {E} SELECT event_id FROM e WHERE split = 'test' AND loss >= (SELECT quantile_cont(loss, 0.99) FROM e WHERE split = 'val')")
def incident_seeds(spark, d):
    """Every seed is in exactly one incident."""
    rows, _ = incident_rows(spark, d)
    return rows.where("role = 'seed'").select("event_id")


@query("incidents", "incident:l start_time:l end_time:l seeds:l connectors:l contexts:l")
def incidents(spark, d):
    """I3, I6, I8, A22, G17, G19, G20, G23, O3."""
    rows, e = incident_rows(spark, d)
    return I.summary(rows, e)


@query("incident_slices", "incident:l role:s n:l")
def incident_slices(spark, d):
    """A limit is part of the request."""
    rows, _ = incident_rows(spark, d)
    return T.bounded_slice(rows, 10).groupBy("incident", "role").agg(F.count("*").alias("n"))


@query("incident_coverage", "coverage_seeds:d coverage_core:d coverage_context:d benign_fraction:d fragmentation:d mixed:l")
def incident_coverage(spark, d):
    """E16, E17."""
    rows, e = incident_rows(spark, d)
    members = rows.join(e.select("event_id", "src", "dst"), "event_id").select("incident", "role", F.explode(F.array("src", "dst")).alias("node")).distinct()
    present = truth(e)
    return M.coverage(members, present)


@query("nearest_seeds", "event_id:l near:l", """WITH {E}, x AS (SELECT event_id, t, w // 24 AS w, loss FROM e WHERE split = 'test'), s AS (SELECT x.* FROM x, thr WHERE loss >= thr) SELECT event_id, coalesce((SELECT min(abs(s.t - x.t)) FROM s WHERE s.w = x.w), 4611686018427387904) AS near FROM x""")
def nearest_seeds(spark, d):
    """the distance that costs depend on, J12 on both sides."""
    e = edges(spark, d)
    x = e.where("split = 'test'").withColumn("w", F.floor(F.col("w") / 24))
    return I.nearest_seed(x, A.seeds(x, A.threshold(e.where("split = 'val'"), "nodlink")))


@query("complete_epochs", "epoch:l", """WITH {E}, x AS (SELECT event_id, op FROM e WHERE split = 'test'), s AS (SELECT k AS epoch, event_id FROM x, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE (k <> 3 OR op <> 'error') UNION ALL SELECT 4, min(event_id) FROM x)
    SELECT max(epoch) AS epoch FROM (SELECT epoch FROM s GROUP BY epoch HAVING count(*) = (SELECT count(*) FROM x) AND count(DISTINCT event_id) = (SELECT count(*) FROM x))""")
def complete_epochs(spark, d):
    """Of four epochs the third lacks an operation, and the fourth has an event twice."""
    e = test_edges(spark, d)
    s = e.select(F.explode(F.array(*map(F.lit, range(1, 5)))).alias("epoch"), "event_id", "op")
    again = e.agg(F.min("event_id").alias("event_id")).select(F.lit(4).alias("epoch"), "event_id")
    return I.complete_epoch(s.where("epoch <> 3 or op <> 'error'").select("epoch", "event_id").unionByName(again), e)

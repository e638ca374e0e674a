"""Queries on edges: selection, joins, windows, aggregates and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import scalars as S
from auditloom.operators import features, joins, provenance as P, scoring, windows
from auditloom.plans.registry import query


def edges(spark, d):
    return windows.tumbling(P.events(spark, d))


def truth(e):
    """(node, attack) by rule."""
    nodes = P.endpoints(e).distinct()
    attack = F.when(F.col("node") >= 1_000_000, (F.col("node") - 1_000_000) % 17).otherwise((F.col("node") - 1) % 11)
    return nodes.withColumn("attack", attack).where("attack < 3")


def nodes(e):
    """(node, type, label): labels are made from the ids."""
    n = P.endpoints(e).distinct()
    kind = F.when(F.col("node") >= 1_000_000, "file").otherwise("subject")
    return n.select("node", kind.alias("type"), F.when(F.col("node") >= 1_000_000, F.concat(F.lit("/data/d"), (F.col("node") % 7).cast("string"), F.lit("/f"), F.col("node").cast("string"))).otherwise(F.concat(F.lit("/usr/bin/u"), F.col("node").cast("string"))).alias("label"))


NODES = "nodes AS (SELECT DISTINCT node, CASE WHEN node >= 1000000 THEN 'file' ELSE 'subject' END AS type, CASE WHEN node >= 1000000 THEN '/data/d' || (node % 7) || '/f' || node ELSE '/usr/bin/u' || node END AS label FROM ends)"


@query("scan_edges", "event_id:l t:l src:l dst:l op:s src_type:s dst_type:s split:s", "WITH {E} SELECT * FROM e")
def scan_edges(spark, d):
    """P3, O1."""
    return edges(spark, d)


@query("allow_list", "event_id:l op:s", "WITH {E} SELECT * FROM e WHERE op IN ('view', 'purchase')")
def allow_list(spark, d):
    """P1."""
    return P.allowed(edges(spark, d), ("view", "purchase"))


@query("exclude_list", "op:s n:l", "WITH {E} SELECT op, count(*) AS n FROM e WHERE op NOT IN ('error', 'signup') GROUP BY op")
def exclude_list(spark, d):
    """P2."""
    return P.not_excluded(edges(spark, d), ("error", "signup")).groupBy("op").agg(F.count("*").alias("n"))


@query("node_labels", "node:l label:s hashed:s display:s", f"WITH {{E}}, {NODES} SELECT node, label, sha256(label) AS hashed, type || '-' || label AS display FROM nodes")
def node_labels(spark, d):
    """P4, P5, F1, F33."""
    return nodes(edges(spark, d)).withColumns({"hashed": S.digest(F.col("label")), "display": S.display_label(F.col("type"), F.col("label"))})


@query("used_nodes", "node:l", "WITH {E} SELECT DISTINCT node FROM ends WHERE split <> 'train'")
def used_nodes(spark, d):
    """P6, U1."""
    e = edges(spark, d)
    return P.split_nodes(e).where("split <> 'train'").select("node").distinct()


@query("benign_keywords", "doc_id:l hit:b", "SELECT doc_id, contains(text, ':') OR contains(text, 'usr') OR contains(text, 'null') OR contains(text, 'tmp') AS hit FROM documents")
def benign_keywords(spark, d):
    """P7."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.contains_any(F.col("text"), (":", "usr", "null", "tmp")).alias("hit"))


@query("time_range", "event_id:l", "WITH {E} SELECT event_id FROM e WHERE t > 1705708800000000000 AND t < 1705795200000000000")
def time_range(spark, d):
    """Strict bounds."""
    return P.between(edges(spark, d), 1705708800000000000, 1705795200000000000, strict=True)


@query("range_both_ends", "event_id:l", "WITH {E} SELECT event_id FROM e WHERE t BETWEEN 1705708800000000000 AND 1706140800000000000 AND src IN (SELECT node FROM truth) AND dst IN (SELECT node FROM truth)")
def range_both_ends(spark, d):
    """S11, S12."""
    e = edges(spark, d)
    return P.among(P.between(e, 1705708800000000000, 1706140800000000000), truth(e))


@query("malicious_edges", "event_id:l src_node:l both_nodes:l either_node:l", """WITH {E} SELECT event_id, s AS src_node, s * d AS both_nodes, greatest(s, d) AS either_node FROM (
    SELECT event_id, CASE WHEN src IN (SELECT node FROM truth) THEN 1 ELSE 0 END AS s, CASE WHEN dst IN (SELECT node FROM truth) THEN 1 ELSE 0 END AS d FROM e)""")
def malicious_edges(spark, d):
    """P11."""
    e = edges(spark, d)
    out = e.select("event_id", "src", "dst")
    for rule in ("src_node", "both_nodes", "either_node"):
        out = P.malicious_edges(out, truth(e), rule).withColumnRenamed("y", rule)
    return out


@query("benign_training", "n:l", "WITH {E} SELECT count(*) AS n FROM e WHERE split = 'train' AND src NOT IN (SELECT node FROM truth) AND dst NOT IN (SELECT node FROM truth) AND src <> dst")
def benign_training(spark, d):
    """P12, P13."""
    e = edges(spark, d)
    return P.without_loops(P.malicious_edges(e.where("split = 'train'"), truth(e)).where("y <> 1")).agg(F.count("*").alias("n"))


@query("typed_edges", "event_id:l triplet:l", """WITH {E} SELECT event_id, CASE WHEN src_type = 'subject' AND op = 'purchase' THEN 1 WHEN src_type = 'file' AND op = 'view' THEN 2 ELSE 0 END AS triplet
    FROM e WHERE (src_type = 'subject' AND dst_type = 'file' AND op IN ('purchase', 'signup')) OR (src_type = 'file' AND dst_type = 'subject' AND op IN ('view', 'click'))""")
def typed_edges(spark, d):
    """P16 and the triplet index."""
    kept = P.typed(edges(spark, d), {("subject", "file"): ("purchase", "signup"), ("file", "subject"): ("view", "click")})
    return P.triplet_index(kept, [("subject", "file", "signup"), ("subject", "file", "purchase"), ("file", "subject", "view")])


@query("labelled_edges", "event_id:l src_label:s dst_label:s", f"WITH {{E}}, {NODES} SELECT event_id, a.label AS src_label, b.label AS dst_label FROM e JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node")
def labelled_edges(spark, d):
    """J1, G1."""
    e = edges(spark, d)
    return P.with_labels(e, nodes(e))


@query("truth_matches", "found:l missing:l", "WITH {E} SELECT count(CASE WHEN node IN (SELECT node FROM ends WHERE split = 'test') THEN 1 END) AS found, count(CASE WHEN node NOT IN (SELECT node FROM ends WHERE split = 'test') THEN 1 END) AS missing FROM (SELECT DISTINCT node FROM truth)")
def truth_matches(spark, d):
    """All nodes of the ground truth, looked up among those of the test period."""
    e = edges(spark, d)
    return P.flagged(truth(e).select("node").distinct(), P.endpoints(e.where("split = 'test'")), "node", "in_").agg(F.sum("in_").alias("found"), F.sum(1 - F.col("in_")).alias("missing"))


def attacks(spark):
    base = 1706227200000000000
    rows = [(a, base + a * P.DAY, base + a * P.DAY + 20 * P.HOUR) for a in range(3)]
    return spark.createDataFrame(rows, "attack_id long, start long, end long")


ATTACKS = "att AS (SELECT a AS attack_id, 1706227200000000000 + a * 86400000000000::BIGINT AS s, 1706227200000000000 + a * 86400000000000::BIGINT + 72000000000000::BIGINT AS f FROM (SELECT unnest(range(0, 3))::BIGINT AS a))"


@query("attack_window_events", "attack_id:l event_id:l node:l", f"WITH {{E}}, {ATTACKS} SELECT attack_id, event_id, node FROM ends JOIN att ON t BETWEEN s AND f WHERE node IN (SELECT node FROM truth WHERE truth.attack = attack_id)")
def attack_window_events(spark, d):
    """Both ends count."""
    e = edges(spark, d)
    both = joins.interval_join(e.select("event_id", "t", "src", "dst"), attacks(spark), P.DAY)
    rows = P.endpoints(both, "attack_id", "event_id")
    return rows.join(truth(e).withColumnRenamed("attack", "attack_id"), ["attack_id", "node"], "left_semi")


@query("window_labels", "w:l node:l n:l", """WITH {E}, spans AS (SELECT w, min(t) AS s, max(t) AS f FROM e GROUP BY w)
    SELECT spans.w, node, count(*) AS n FROM ends JOIN spans ON t > s AND t < f WHERE split = 'test' AND node IN (SELECT node FROM truth) GROUP BY spans.w, node""")
def window_labels(spark, d):
    """Strict bounds, as the first and last event of a window never label it."""
    e = edges(spark, d)
    spans = e.groupBy("w").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    marks = P.endpoints(e.where("split = 'test'"), "t").join(truth(e).select("node").distinct(), "node", "left_semi")
    return joins.interval_join(marks, spans, P.HOUR, strict=True).groupBy("w", "node").agg(F.count("*").alias("n"))


@query("score_alignment", "missing:l ambiguous:l unscored:l repeated:l", "WITH {E} SELECT 0 AS missing, 0 AS ambiguous, (SELECT count(*) FROM e WHERE split = 'test' AND op = 'error') AS unscored, 0 AS repeated")
def score_alignment(spark, d):
    """J4, J5, S21."""
    e = edges(spark, d).where("split = 'test'")
    keys = ("src", "dst", "t", "op", "event_id")
    return joins.mismatches(e.where("op <> 'error'").select(*keys, "loss"), e.select(*keys), keys)


@query("seen_nodes", "node:l is_seen:l y_true:l", "WITH {E} SELECT DISTINCT node, CASE WHEN node IN (SELECT node FROM ends WHERE split = 'train') THEN 1 ELSE 0 END AS is_seen, CASE WHEN node IN (SELECT node FROM truth) THEN 1 ELSE 0 END AS y_true FROM ends WHERE split = 'test'")
def seen_nodes(spark, d):
    """J6, J7."""
    e = edges(spark, d)
    rows = P.endpoints(e.where("split = 'test'")).distinct()
    return P.flagged(P.flagged(rows, P.endpoints(e.where("split = 'train'")), "node", "is_seen"), truth(e), "node", "y_true")


@query("seed_band_pairs", "a:l b:l share:b", """WITH {E}, s AS (SELECT e.* FROM e, thr WHERE split = 'test' AND loss >= thr)
    SELECT x.event_id AS a, y.event_id AS b, x.src IN (y.src, y.dst) OR x.dst IN (y.src, y.dst) AS share FROM s x JOIN s y ON abs(x.t - y.t) <= 3600000000000 AND (x.t < y.t OR (x.t = y.t AND x.event_id < y.event_id))""")
def seed_band_pairs(spark, d):
    """J10, J11, P9, I2, I5."""
    e = edges(spark, d)
    s = scoring.seeds(e.where("split = 'test'"), scoring.threshold(e.where("split = 'val'"), "nodlink")).select("event_id", "t", "src", "dst")
    pairs = joins.band_join(s, s, P.HOUR).where("t < t_r or (t = t_r and event_id < event_id_r)")
    return pairs.select(F.col("event_id").alias("a"), F.col("event_id_r").alias("b"), F.expr("src in (src_r, dst_r) or dst in (src_r, dst_r)").alias("share"))


@query("asof_previous", "event_id:l before:l after:l", """WITH {E}, m AS (SELECT DISTINCT src, t FROM e WHERE op = 'error'), b AS (SELECT x.event_id, max(m.t) AS before FROM e x JOIN m ON m.src = x.src AND m.t < x.t GROUP BY x.event_id), a AS (SELECT x.event_id, min(m.t) AS after FROM e x JOIN m ON m.src = x.src AND m.t > x.t GROUP BY x.event_id)
    SELECT e.event_id, before, after FROM e LEFT JOIN b ON e.event_id = b.event_id LEFT JOIN a ON e.event_id = a.event_id""")
def asof_previous(spark, d):
    """J12 over all edges."""
    e = edges(spark, d).select("event_id", "src", "t", "op")
    marks = e.where("op = 'error'").select("src", "t", F.col("t").alias("mark"))
    back = joins.asof_join(e, marks, ["src"], "mark").withColumnRenamed("mark_asof", "before")
    return joins.asof_join(back, marks, ["src"], "mark", backward=False).withColumnRenamed("mark_asof", "after")


@query("two_event_paths", "n:l", "WITH {E} SELECT count(*) AS n FROM e a JOIN e b ON a.dst = b.src AND a.t <= b.t AND a.event_id <> b.event_id AND a.w = b.w WHERE a.split = 'test' AND b.split = 'test'")
def two_event_paths(spark, d):
    """J13."""
    e = edges(spark, d).where("split = 'test'").select("event_id", "src", "dst", "t", "w")
    b = e.withColumnsRenamed({"event_id": "e2", "src": "mid", "t": "t2", "w": "w2", "dst": "d2"})
    return e.join(b, (F.col("dst") == F.col("mid")) & (F.col("w") == F.col("w2"))).where("t <= t2 and event_id <> e2").agg(F.count("*").alias("n"))


@query("undirected", "src:l dst:l n:l", "WITH {E}, back AS (SELECT dst AS src, src AS dst FROM e WHERE split = 'test' AND (dst, src) NOT IN (SELECT (src, dst) FROM e WHERE split = 'test')) SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM e WHERE split = 'test' UNION ALL SELECT src, dst FROM back) GROUP BY src, dst")
def undirected(spark, d):
    """G2, J14."""
    return P.undirected(edges(spark, d).where("split = 'test'").select("src", "dst", "event_id")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("untouched_files", "src:l n:l", "WITH {E}, t AS (SELECT DISTINCT src, dst FROM e WHERE src_type = 'subject' AND split = 'test'), f AS (SELECT count(DISTINCT dst) AS k FROM t) SELECT src, max(k) - count(*) AS n FROM t, f GROUP BY src")
def untouched_files(spark, d):
    """By counting, without forming pairs."""
    t = edges(spark, d).where("src_type = 'subject' and split = 'test'").select("src", "dst").distinct()
    return t.groupBy("src").agg(F.count("*").alias("n_")).crossJoin(F.broadcast(t.agg(F.countDistinct("dst").alias("k")))).select("src", (F.col("k") - F.col("n_")).alias("n"))


@query("edge_truth", "event_id:l y:l", "WITH {E} SELECT x.event_id, CASE WHEN EXISTS (SELECT 1 FROM e g WHERE g.op = 'error' AND g.loss > 100 AND g.src = x.src AND g.dst = x.dst AND g.t = x.t AND g.op = x.op) THEN 1 ELSE 0 END AS y FROM e x WHERE split = 'test'")
def edge_truth(spark, d):
    """J18."""
    e = edges(spark, d).where("split = 'test'")
    known = e.where("op = 'error' and loss > 100").select("src", "dst", "t", "op").distinct().withColumn("k", F.lit(1))
    return e.join(known, ["src", "dst", "t", "op"], "left").select("event_id", F.coalesce("k", F.lit(0)).alias("y"))


@query("nodes_in_both", "node:l", "WITH {E} SELECT node FROM ends WHERE split = 'train' AND type_ok INTERSECT SELECT node FROM ends WHERE split = 'val' AND type_ok".replace("type_ok", "node < 1000000"))
def nodes_in_both(spark, d):
    """J21, U3."""
    s = P.split_nodes(edges(spark, d)).where("node < 1000000")
    return s.where("split = 'train'").select("node").intersect(s.where("split = 'val'").select("node"))


@query("ambiguous_nodes", "node:l n:l", "WITH {E}, m AS (SELECT node, node % 5 AS a FROM ends UNION SELECT node, node % 7 AS a FROM ends) SELECT node, count(DISTINCT a) AS n FROM m GROUP BY node HAVING count(DISTINCT a) > 1")
def ambiguous_nodes(spark, d):
    """U5, U6, U7."""
    n = P.endpoints(edges(spark, d)).distinct()
    m = n.select("node", (F.col("node") % 5).alias("a")).union(n.select("node", F.col("node") % 7)).distinct()
    return m.groupBy("node").agg(F.countDistinct("a").alias("n")).where("n > 1")


@query("appended_events", "split:s event_id:l t:l rn:l", "WITH {E}, x AS (SELECT split, event_id, t FROM e UNION ALL SELECT split, event_id + 10000000, t + 1 FROM e WHERE op = 'error') SELECT split, event_id, t, row_number() OVER (PARTITION BY split ORDER BY t, event_id) - 1 AS rn FROM x")
def appended_events(spark, d):
    """U2 in every split; each is ordered by itself."""
    e = edges(spark, d)
    more = e.where("op = 'error'").select((F.col("event_id") + 10_000_000).alias("event_id"), (F.col("t") + 1).alias("t"), "split")
    return windows.numbered(e.select("event_id", "t", "split").unionByName(more), "split")


@query("hour_windows", "w:l n:l first_t:l last_t:l", "WITH {E} SELECT w, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM e GROUP BY w")
def hour_windows(spark, d):
    """T1, T3."""
    return edges(spark, d).groupBy("w").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("sliding_windows", "w:l n:l", "WITH {E} SELECT t // 7200000000000 AS w, count(*) AS n FROM e WHERE t % 7200000000000 < 3600000000000 GROUP BY 1")
def sliding_windows(spark, d):
    """Windows shorter than their slide."""
    return windows.sliding(edges(spark, d), 2 * P.HOUR, P.HOUR).groupBy("w").agg(F.count("*").alias("n"))


@query("count_batches", "split:s batch:l n:l first_t:l", "WITH {E}, b AS (SELECT split, t, (row_number() OVER (PARTITION BY split ORDER BY t, event_id) - 1) // 100 AS batch FROM e) SELECT split, batch, count(*) AS n, min(t) AS first_t FROM b GROUP BY split, batch")
def count_batches(spark, d):
    """T4, W18."""
    return windows.batches(edges(spark, d), 100, "split").groupBy("split", "batch").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query("grouped_windows", "g:l n:l", "WITH {E} SELECT w // 6 AS g, count(*) AS n FROM e GROUP BY 1")
def grouped_windows(spark, d):
    """T6."""
    return edges(spark, d).groupBy(windows.grouped_windows(F.col("w"), 6).alias("g")).agg(F.count("*").alias("n"))


@query("hybrid_windows", "day:l hw:l n:l hw_start:l", """WITH RECURSIVE {E}, b AS (
    SELECT day, batch, min(t) AS a, max(t) AS z, count(*) AS n FROM (SELECT t, t // 86400000000000 AS day, (row_number() OVER (PARTITION BY t // 86400000000000 ORDER BY t, event_id) - 1) // 64 AS batch FROM e) GROUP BY day, batch
), f AS (
    SELECT day, batch, n, 0 AS hw, a AS s, z FROM b WHERE batch = 0
    UNION ALL SELECT b.day, b.batch, b.n, CASE WHEN f.z > f.s + 14400000000000 THEN f.hw + 1 ELSE f.hw END, CASE WHEN f.z > f.s + 14400000000000 THEN f.z ELSE f.s END, b.z FROM f JOIN b ON b.day = f.day AND b.batch = f.batch + 1
) SELECT day, hw, sum(n) AS n, min(s) AS hw_start FROM f GROUP BY day, hw""")
def hybrid_windows(spark, d):
    """Here batches of 64 events and four hours."""
    e = windows.days(edges(spark, d))
    return windows.hybrid_windows(e, 4 * P.HOUR, 64).groupBy("day", "hw").agg(F.count("*").alias("n"), F.min("hw_start").alias("hw_start"))


@query("unique_pair_parts", "w:l parts:l n:l")
def unique_pair_parts(spark, d):
    """T5."""
    return windows.unique_pair_parts(edges(spark, d), "w").groupBy("w").agg((F.max("part") + 1).alias("parts"), F.count("*").alias("n"))


@query("fused_edges", "event_id:l", "WITH {E} SELECT event_id FROM (SELECT event_id, op, lag(op) OVER (PARTITION BY split, src, dst ORDER BY t, event_id) AS p FROM e) WHERE p IS NULL OR p <> op")
def fused_edges(spark, d):
    """W1."""
    return windows.fuse(edges(spark, d), "split")


@query("edge_keys", "event_id:l key:l", "WITH {E} SELECT event_id, row_number() OVER (PARTITION BY split, src, dst ORDER BY t, event_id) - 1 AS key FROM e")
def edge_keys(spark, d):
    """W2."""
    return windows.edge_keys(edges(spark, d), "split")


@query("idle_gaps", "node:l gap_min:l gap_max:l gap_mean:d lifespan:l active:l", """WITH {E}, g AS (SELECT node, t, t - lag(t) OVER (PARTITION BY node ORDER BY t, event_id) AS gap FROM ends), q AS (SELECT node, quantile_cont(gap, 0.01) AS q FROM g GROUP BY node)
    SELECT g.node, coalesce(min(gap), 0) AS gap_min, coalesce(max(gap), 0) AS gap_max, coalesce(sum(gap)::DOUBLE / count(gap), 0) / 1e9 AS gap_mean, max(t) - min(t) AS lifespan, coalesce(sum(CASE WHEN gap <= q THEN gap END), 0) AS active FROM g JOIN q ON g.node = q.node GROUP BY g.node""")
def idle_gaps(spark, d):
    """W3, W5, A24."""
    return windows.idle_gaps(edges(spark, d)).withColumn("gap_mean", F.col("gap_mean") / 1e9)


@query("node_versions", "event_id:l src_version:l dst_version:l", """WITH {E}, x AS (SELECT event_id, t, src AS node, 0 AS a FROM e UNION ALL SELECT event_id, t, dst, 1 FROM e),
    v AS (SELECT event_id, a, sum(a) OVER (PARTITION BY node ORDER BY t, event_id, a ROWS UNBOUNDED PRECEDING) AS v FROM x)
    SELECT event_id, max(CASE WHEN a = 0 THEN v END) AS src_version, max(CASE WHEN a = 1 THEN v END) AS dst_version FROM v GROUP BY event_id""")
def node_versions(spark, d):
    """W8 over all edges."""
    return windows.versions(edges(spark, d))


@query("next_windows", "node:l w:l w_end:l", "WITH {E} SELECT node, w, lead(w) OVER (PARTITION BY node ORDER BY w) AS w_end FROM (SELECT DISTINCT node, w FROM ends WHERE split = 'test')")
def next_windows(spark, d):
    """W9."""
    return windows.next_window(P.endpoints(edges(spark, d).where("split = 'test'"), "w"))


@query("first_events", "node:l event_id:l", "WITH {E} SELECT node, event_id FROM (SELECT node, event_id, row_number() OVER (PARTITION BY node ORDER BY t, event_id) AS rn FROM ends) WHERE rn = 1")
def first_events(spark, d):
    """W10."""
    return windows.first_per(P.endpoints(edges(spark, d), "t", "event_id"), "node", "t", "event_id")


@query("top_losses", "op:s event_id:l rank:l", "WITH {E} SELECT op, event_id, rn AS rank FROM (SELECT op, event_id, row_number() OVER (PARTITION BY op ORDER BY loss DESC, event_id) AS rn FROM e) WHERE rn <= 5")
def top_losses(spark, d):
    """W17."""
    return windows.top_per(edges(spark, d), "op", 5, F.col("loss").desc(), F.col("event_id"))


@query("last_neighbours", "w:l node:l neighbours:s", """WITH {E}, x AS (SELECT DISTINCT w, node FROM ends), h AS (SELECT x.w, x.node, y.other, y.t, y.event_id, row_number() OVER (PARTITION BY x.w, x.node ORDER BY y.t DESC, y.event_id DESC) AS rn FROM x JOIN ends y ON y.node = x.node AND y.w < x.w),
    a AS (SELECT w, node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY t, event_id) AS neighbours FROM h WHERE rn <= 5 GROUP BY w, node) SELECT x.w, x.node, coalesce(neighbours, '') AS neighbours FROM x LEFT JOIN a ON a.w = x.w AND a.node = x.node""")
def last_neighbours(spark, d):
    """Neighbours carry over from split to split. Tests hold it against brute force."""
    out = windows.last_neighbours(edges(spark, d), 5, "w")
    return out.withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ","))


@query("last_updates", "event_id:l node:l last_t:l", "WITH {E} SELECT event_id, node, max(t) OVER (PARTITION BY node ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_t FROM ends")
def last_updates(spark, d):
    """W12, T9 over all edges: times carry over from split to split."""
    return windows.last_update(edges(spark, d))


@query("last_messages", "w:l node:l last_op:s", "WITH {E} SELECT w, node, op AS last_op FROM (SELECT w, node, op, row_number() OVER (PARTITION BY w, node ORDER BY t DESC, event_id DESC) AS rn FROM ends) WHERE rn = 1")
def last_messages(spark, d):
    """W13, T8 over all edges."""
    return windows.last_message(edges(spark, d), "w")


@query("time_disorder", "n:l", "WITH {E}, s AS (SELECT w, min(t) AS lo, max(t) AS hi FROM e GROUP BY w) SELECT count(*) AS n FROM (SELECT lo, max(hi) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM s) WHERE lo < past")
def time_disorder(spark, d):
    """W14, T10."""
    return windows.disorder(edges(spark, d)).agg(F.count("*").alias("n"))


@query("root_nodes", "node:l", "WITH {E}, o AS (SELECT src AS node, min(t) AS a FROM e WHERE split = 'test' GROUP BY src), i AS (SELECT dst AS node, min(t) AS b FROM e WHERE split = 'test' GROUP BY dst) SELECT o.node FROM o LEFT JOIN i ON o.node = i.node WHERE b IS NULL OR a < b")
def root_nodes(spark, d):
    """W15."""
    return windows.roots(edges(spark, d).where("split = 'test'"))


@query("split_nodes", "split:s n:l", "WITH {E} SELECT split, count(DISTINCT node) AS n FROM ends GROUP BY split")
def split_nodes(spark, d):
    """A23."""
    return P.split_nodes(edges(spark, d)).groupBy("split").agg(F.count("*").alias("n"))


@query("relation_counts", "node:l op:s n_in:l n_out:l", "WITH {E} SELECT node, op, sum(CASE WHEN dst = node THEN 1 ELSE 0 END) AS n_in, sum(CASE WHEN src = node THEN 1 ELSE 0 END) AS n_out FROM ends GROUP BY node, op")
def relation_counts(spark, d):
    """A15."""
    return scoring.relation_counts(edges(spark, d))


@query("relation_shares", "w:l node:l op:s share:d", "WITH {E}, c AS (SELECT w, node, op, sum(CASE WHEN src = node THEN 1 ELSE 0 END) AS n FROM ends WHERE split = 'test' GROUP BY w, node, op), m AS (SELECT w, max(n) AS m FROM c GROUP BY w) SELECT c.w, node, op, coalesce(n / nullif(m, 0)::DOUBLE, 0) AS share FROM c JOIN m ON c.w = m.w")
def relation_shares(spark, d):
    """Counts over the greatest of the window."""
    c = scoring.relation_counts(edges(spark, d).where("split = 'test'"), "w")
    m = c.groupBy("w").agg(F.max("n_out").alias("m"))
    return c.join(m, "w").select("w", "node", "op", F.coalesce(F.try_divide(F.col("n_out").cast("double"), F.col("m")), F.lit(0.0)).alias("share"))


@query("class_weights", "op:s weight:d", "WITH {E} SELECT op, (SELECT count(*) FROM e)::DOUBLE / ((SELECT count(DISTINCT op) FROM e) * count(*)) AS weight FROM e GROUP BY op")
def class_weights(spark, d):
    """A17."""
    e = edges(spark, d)
    return scoring.class_weights(e, "op", e.select("op").distinct())


@query("mean_vectors", "label:l i:l x:d", "SELECT label, i - 1 AS i, avg(embedding[i]) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i")
def mean_vectors(spark, d):
    """A18, M5."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    v = v.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return scoring.mean_vectors(v, "label", "embedding").select("label", F.posexplode("embedding").alias("i", "x"))


@query("dataset_stats", "split:s windows:l edges_mean:d edges_min:l edges_max:l nodes_mean:d", """WITH {E}, a AS (SELECT split, w, count(*) AS n FROM e GROUP BY split, w), b AS (SELECT split, w, count(DISTINCT node) AS m FROM ends GROUP BY split, w)
    SELECT a.split, count(*) AS windows, avg(n) AS edges_mean, min(n) AS edges_min, max(n) AS edges_max, avg(m) AS nodes_mean FROM a JOIN b ON a.split = b.split AND a.w = b.w GROUP BY a.split""")
def dataset_stats(spark, d):
    """A21."""
    e = edges(spark, d)
    a = e.groupBy("split", "w").agg(F.count("*").alias("n"))
    b = P.endpoints(e, "split", "w").groupBy("split", "w").agg(F.countDistinct("node").alias("m"))
    return a.join(b, ["split", "w"]).groupBy("split").agg(F.count("*").alias("windows"), F.avg("n").alias("edges_mean"), F.min("n").alias("edges_min"), F.max("n").alias("edges_max"), F.avg("m").alias("nodes_mean"))


@query("type_ranges", "op:s lo:d hi:d", "WITH {E} SELECT op, min(loss) AS lo, max(loss) AS hi FROM e WHERE split = 'train' GROUP BY op")
def type_ranges(spark, d):
    """A25."""
    return edges(spark, d).where("split = 'train'").groupBy("op").agg(F.min("loss").alias("lo"), F.max("loss").alias("hi"))


@query("scaled_losses", "event_id:l s:d level:s", "WITH {E}, m AS (SELECT min(loss) AS lo, max(loss) AS hi FROM e) SELECT event_id, CASE WHEN hi <= lo THEN 0 ELSE least(1, greatest(0, (loss - lo) / (hi - lo))) END AS s, CASE WHEN loss <= 1 THEN 'Negligible' WHEN loss <= 10 THEN 'Minor' WHEN loss <= 100 THEN 'Moderate' WHEN loss <= 1000 THEN 'Significant' ELSE 'Critical' END AS level FROM e, m WHERE split = 'test'")
def scaled_losses(spark, d):
    """W4, F21, F23."""
    e = edges(spark, d)
    m = e.agg(F.min("loss").alias("lo"), F.max("loss").alias("hi"))
    return e.where("split = 'test'").crossJoin(F.broadcast(m)).select("event_id", S.unit_range(F.col("loss"), F.col("lo"), F.col("hi")).alias("s"), S.severity(F.col("loss")).alias("level"))


@query("token_counts", "page_id:l n:l first:s", r"WITH t AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(url, '([/:.])', ' \1 ', 'g'), '\s+'), lambda x: x <> '') AS w FROM pages) SELECT page_id, greatest(len(w), 1) AS n, coalesce(w[1], '') AS first FROM t")
def token_counts(spark, d):
    """F12, F11."""
    w = S.any_tokens(F.col("url"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.size(w).alias("n"), F.element_at(w, 1).alias("first"))


@query("path_prefixes", "page_id:l text:s", "WITH t AS (SELECT page_id, string_split(url, '/') AS p FROM pages), x AS (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM t) SELECT page_id, string_agg(array_to_string(p[1:i], '/'), '' ORDER BY i) AS text FROM x GROUP BY page_id")
def path_prefixes(spark, d):
    """F13, F14."""
    return spark.read.parquet(f"{d}/pages.parquet").where("url is not null").select("page_id", S.joined(S.prefixes(F.col("url"))).alias("text"))


@query("document_frequency", "token:s df:l idf:d", r"""WITH t AS (SELECT DISTINCT page_id, unnest(list_filter(string_split_regex(regexp_replace(url, '([/:.])', ' \1 ', 'g'), '\s+'), lambda x: x <> '')) AS token FROM pages)
    SELECT token, count(*) AS df, ln((SELECT count(*) FROM pages)::DOUBLE / (count(*) + 1)) AS idf FROM t GROUP BY token""")
def document_frequency(spark, d):
    """A10, L1."""
    t = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(S.any_tokens(F.col("url"))).alias("token"))
    return scoring.idf(t, "token", "page_id")


@query("event_hashes", "event_id:l h:s", "WITH {E} SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM e")
def event_hashes(spark, d):
    """F2."""
    return edges(spark, d).select("event_id", S.event_uuid_hash(F.col("event_id").cast("string")).alias("h"))


@query("time_texts", "event_id:l utc:s back:l", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) * 1000) % 1000000000 AS VARCHAR), 9, '0') AS utc, epoch_us(date_trunc('second', ts)) * 1000 AS back FROM events")
def time_texts(spark, d):
    """F4-F6 in UTC; the tests cover US Eastern."""
    e = P.events(spark, d)
    text = S.ns_to_text(F.col("t"), "UTC")
    return e.select("event_id", text.alias("utc"), S.text_to_ns(F.substring(text, 1, 19), "UTC").alias("back"))


@query("word_weights", "n:l i:l wt:d", "SELECT n, i, (1.0 / n - 0.5 * (n - 1) * (-10 / (100.0 * n))) + i * (-10 / (100.0 * n)) AS wt FROM (SELECT unnest(range(1, 9)) AS n), LATERAL (SELECT unnest(range(0, n)) AS i)")
def word_weights(spark, d):
    """F15."""
    return spark.range(1, 9).select(F.col("id").alias("n"), F.posexplode(S.word_weights(F.col("id"), 10.0)).alias("i", "wt"))


@query("unit_vectors", "vec_id:l norm:d first:d", "SELECT vec_id, 1.0 AS norm, embedding[1] / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12) AS first FROM embeddings")
def unit_vectors(spark, d):
    """F16."""
    u = S.normalised(F.col("embedding"))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", S.l2(u).alias("norm"), u[0].alias("first"))


@query("behaviour", "node:l in_view:d out_view:d in_purchase:d out_purchase:d gap_min:d gap_max:d gap_mean:d lifespan:d", """WITH {E}, c AS (SELECT node, sum(CASE WHEN dst = node AND op = 'view' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN src = node AND op = 'view' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN dst = node AND op = 'purchase' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN src = node AND op = 'purchase' THEN 1 ELSE 0 END) AS d FROM ends GROUP BY node),
    h AS (SELECT *, greatest(sqrt(a * a + b * b + c * c + d * d), 1) AS h FROM c), g AS (SELECT node, t, t - lag(t) OVER (PARTITION BY node ORDER BY t, event_id) AS gap FROM ends), i AS (SELECT node, coalesce(min(gap), 0)::DOUBLE AS x, coalesce(max(gap), 0)::DOUBLE AS y, coalesce(sum(gap)::DOUBLE / count(gap), 0) AS z, (max(t) - min(t))::DOUBLE AS l FROM g GROUP BY node),
    m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, min(l) AS l0, max(l) AS l1 FROM i)
    SELECT h.node, a / h AS in_view, b / h AS out_view, c / h AS in_purchase, d / h AS out_purchase, coalesce((x - x0) / nullif(x1 - x0, 0), 0) AS gap_min, coalesce((y - y0) / nullif(y1 - y0, 0), 0) AS gap_max, coalesce((z - z0) / nullif(z1 - z0, 0), 0) AS gap_mean, coalesce((l - l0) / nullif(l1 - l0, 0), 0) AS lifespan FROM h JOIN i ON h.node = i.node, m""")
def behaviour(spark, d):
    """Counts by operation have norm 1 in each node, idle times are scaled over all nodes."""
    return features.behaviour(edges(spark, d), ["view", "purchase"])


@query("node_documents", "w:l node:l items:s", """WITH {E}, r AS (SELECT w, node, op, other, t, event_id, row_number() OVER (PARTITION BY w, node ORDER BY t, event_id, other) AS rn FROM ends WHERE split = 'test')
    SELECT w, node, string_agg(node || ' ' || op || ' ' || other, ' ' ORDER BY rn) AS items FROM r WHERE (rn - 1) * 3 < 300 GROUP BY w, node""")
def node_documents(spark, d):
    """L3."""
    return features.documents(edges(spark, d).where("split = 'test'")).select("w", "node", F.array_join("items", " ").alias("items"))


@query("neighbour_corpus", "node:l tokens:s", f"""WITH {{E}}, {NODES}, k AS (SELECT node, array_to_string(list_filter(string_split(replace(label, '/', ' / '), ' '), lambda x: x <> ''), ' ') AS x FROM nodes), p AS (SELECT src, dst, min(t) AS t, min_by(event_id, (t, event_id)) AS i FROM e GROUP BY src, dst)
    SELECT k.node, any_value(k.x) || coalesce(' ' || string_agg(o.x, ' ' ORDER BY p.t, p.i), '') AS tokens FROM k LEFT JOIN p ON p.src = k.node LEFT JOIN k o ON o.node = p.dst GROUP BY k.node""")
def neighbour_corpus(spark, d):
    """L2, F9, F11."""
    e = edges(spark, d)
    tokens = nodes(e).select("node", S.path_tokens(F.col("label")).alias("tokens"))
    return features.neighbour_corpus(e, tokens).select("node", F.array_join("tokens", " ").alias("tokens"))


@query("summed_neighbours", "node:l x:d", "WITH {E} SELECT dst AS node, sum(src % 7) AS x FROM e GROUP BY dst")
def summed_neighbours(spark, d):
    """L12 over all edges."""
    e = edges(spark, d)
    v = P.endpoints(e).distinct().select("node", F.array((F.col("node") % 7).cast("double")).alias("vector"))
    return features.summed_neighbours(e, v).select("node", F.col("vector")[0].alias("x"))


@query("one_class", "vec_id:l score:d", """WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    c AS (SELECT label, i, CASE WHEN abs(avg(v)) < 0.1 THEN CASE WHEN avg(v) < 0 THEN -0.1 ELSE 0.1 END ELSE avg(v) END AS c FROM x GROUP BY label, i),
    f AS (SELECT vec_id, x.label, sum((v - c) * (v - c)) AS d2 FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY vec_id, x.label), r AS (SELECT label, quantile_cont(sqrt(d2), 0.95) AS r FROM f GROUP BY label)
    SELECT vec_id, d2 - r * r AS score FROM f JOIN r ON f.label = r.label""")
def one_class(spark, d):
    """L15."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return features.one_class(v, v)


@query("operation_surprise", "event_id:l loss:d", """WITH {E}, k AS (SELECT count(DISTINCT op) AS k FROM e WHERE split = 'train'), n AS (SELECT src_type, dst_type, op, count(*) AS n FROM e WHERE split = 'train' GROUP BY ALL), m AS (SELECT src_type, dst_type, count(*) AS m FROM e WHERE split = 'train' GROUP BY ALL)
    SELECT event_id, -ln((coalesce(n, 0) + 1.0) / (coalesce(m, 0) + k)) AS loss FROM e CROSS JOIN k LEFT JOIN n USING (src_type, dst_type, op) LEFT JOIN m USING (src_type, dst_type) WHERE split = 'test'""")
def operation_surprise(spark, d):
    """L18 as a relational detector, L13."""
    e = edges(spark, d).drop("loss")
    return scoring.surprise(e.where("split = 'train'"), e.where("split = 'test'"))


@query("confidence", "vec_id:l ratio:d margin:d", "WITH t AS (SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda x: abs(x)::DOUBLE)) AS p FROM embeddings) SELECT vec_id, greatest(ln(p[1] / p[2] + 1e-12), 0) AS ratio, (p[1] - p[2]) / (p[1] + 1e-6) AS margin FROM t")
def confidence(spark, d):
    """L16."""
    p = F.transform(F.col("embedding"), lambda x: F.abs(x).cast("double"))
    ratio, margin = features.confidence(p)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", ratio.alias("ratio"), margin.alias("margin"))


@query("negative_edges", "src:l dst:l")
def negative_edges(spark, d):
    """L20, over all edges: windows are groups."""
    return features.negatives(edges(spark, d))


@query("knn_outliers", "vec_id:l score:d")
def knn_outliers(spark, d):
    """L9, A28."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return features.knn_outliers(v, v)

"""Queries on scores: thresholds, verdicts, metrics and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.vocabulary import BENIGN_KEYWORDS
from auditloom.operators import metrics as M, provenance as P, scoring as A
from auditloom.plans.core import edges, truth
from auditloom.plans.registry import query


def predictions(spark, d):
    """(node, score, worst_window, y, y_hat) of the test period, against the 90th percentile of validation losses."""
    e = edges(spark, d)
    at = A.threshold(e.where("split = 'val'"), "nodlink")
    scored = A.verdicts(A.node_scores(e.where("split = 'test'")), at)
    return P.flagged(scored, truth(e), "node", "y")


def attacks(spark, d):
    return truth(edges(spark, d))


@query("flagship", "node:l score:d worst_window:l y:l", "WITH {E} SELECT p.node, p.score, (SELECT min(w) FROM ends WHERE split = 'test' AND ends.node = p.node AND ends.loss = p.score) AS worst_window, p.y FROM pred p WHERE p.y_hat = 1")
def flagship(spark, d):
    """Nodes of the test period above the validation threshold."""
    return predictions(spark, d).where("y_hat = 1")


@query("loss_stats", "max:d mean:d percentile_90:d std:d", "WITH {E} SELECT max(loss) AS max, avg(loss) AS mean, quantile_cont(loss, 0.9) AS percentile_90, stddev_pop(loss) AS std FROM e WHERE split = 'val'")
def loss_stats(spark, d):
    """A1."""
    return A.loss_stats(edges(spark, d).where("split = 'val'"))


@query("thresholds", "method:s thr:d", """WITH {E}, v AS (SELECT loss FROM e WHERE split = 'val') SELECT 'max_val_loss' AS method, max(loss) AS thr FROM v UNION ALL SELECT 'mean_val_loss', avg(loss) FROM v UNION ALL SELECT 'nodlink', quantile_cont(loss, 0.9) FROM v
    UNION ALL SELECT 'threatrace', 1.5 UNION ALL SELECT 'flash', 0.53 UNION ALL SELECT 'ocrapt', quantile_cont(loss, 0.95) FROM v UNION ALL SELECT 'magic', avg(loss) FROM e WHERE split = 'test' UNION ALL SELECT 'seed_max', max(loss) FROM v UNION ALL SELECT 'seed_0', min(loss) FROM v UNION ALL SELECT 'seed_37.5', quantile_cont(loss, 0.375) FROM v UNION ALL SELECT 'seed_99', quantile_cont(loss, 0.99) FROM v""")
def thresholds(spark, d):
    """A2, A4: seed thresholds by the maximum and by several percentiles."""
    e = edges(spark, d)
    v, t = e.where("split = 'val'"), e.where("split = 'test'")
    names = ("max_val_loss", "mean_val_loss", "nodlink", "threatrace", "flash", "ocrapt", "magic")
    rows = [(n, float(A.threshold(v, n, 0.05, t))) for n in names] + [("seed_max", A.seed_threshold(v))]
    rows += [(f"seed_{x:g}", A.seed_threshold(v, "percentile", x)) for x in (0, 37.5, 99)]
    return spark.createDataFrame(rows, "method string, thr double")


@query("type_thresholds", "src_type:s contamination:d threshold:d", """WITH {E}, v AS (SELECT src_type, loss, CASE WHEN src IN (SELECT node FROM truth) THEN 1 ELSE 0 END AS y FROM e WHERE split = 'val'), c AS (SELECT src_type, greatest(0.01, least(0.2, avg(y))) AS contamination, count(*) AS n FROM v GROUP BY src_type),
    r AS (SELECT v.src_type, loss, contamination, row_number() OVER (PARTITION BY v.src_type ORDER BY loss) - 1 AS rn, (1 - contamination) * (n - 1) AS place FROM v JOIN c ON v.src_type = c.src_type)
    SELECT src_type, max(contamination) AS contamination, sum(loss * (1 - abs(rn - place))) / sum(1 - abs(rn - place)) AS threshold FROM r WHERE abs(rn - place) < 1 GROUP BY src_type""")
def type_thresholds(spark, d):
    """A3."""
    e = edges(spark, d)
    v = P.malicious_edges(e.where("split = 'val'"), truth(e), "src_node")
    return A.thresholds_per_type(v, "src_type", "y", 0.01, 0.2)


@query("typed_verdicts", "node:l y_hat:l", """WITH {E}, q AS (SELECT src_type, quantile_cont(loss, 0.9) AS thr FROM e WHERE split = 'val' AND src_type = 'file' GROUP BY src_type), m AS (SELECT avg(thr) AS m FROM q)
    SELECT node, CASE WHEN score > coalesce(q.thr, m) THEN 1 ELSE 0 END AS y_hat FROM pred CROSS JOIN m LEFT JOIN q ON q.src_type = CASE WHEN node >= 1000000 THEN 'file' ELSE 'subject' END""")
def typed_verdicts(spark, d):
    """One type has a threshold, the other takes the mean."""
    v = edges(spark, d).where("split = 'val' and src_type = 'file'")
    thr = v.groupBy(F.col("src_type").alias("type")).agg(F.percentile("loss", 0.9).alias("threshold"))
    rows = predictions(spark, d).drop("y_hat").withColumn("type", F.when(F.col("node") >= 1_000_000, "file").otherwise("subject"))
    return A.typed_verdicts(rows, thr, "type")


@query("gated_verdicts", "node:l score:d y_hat:l", "WITH {E} SELECT node, max(loss) AS score, max(CASE WHEN loss > 100 AND op = 'view' THEN 1 ELSE 0 END) AS y_hat FROM ends WHERE split = 'test' GROUP BY node")
def gated_verdicts(spark, d):
    """Views stand for nodes whose type was predicted rightly."""
    rows = P.endpoints(edges(spark, d).where("split = 'test'"), "loss", (F.col("op") == "view").cast("int").alias("correct_pred"))
    return A.gated_verdicts(rows, "loss", 100.0, "correct_pred")


@query("window_node_scores", "w:l node:l score:d", "WITH {E} SELECT w, node, avg(loss) AS score FROM ends WHERE split = 'test' GROUP BY w, node")
def window_node_scores(spark, d):
    """A8."""
    return A.window_scores(P.endpoints(edges(spark, d).where("split = 'test'"), "loss", "w"), "mean_val_loss", "w", "node")


@query("window_scores", "w:l score:d y_hat:l", "WITH {E} SELECT w, max(loss) AS score, CASE WHEN max(loss) > any_value(thr) THEN 1 ELSE 0 END AS y_hat FROM e, thr WHERE split = 'test' GROUP BY w")
def window_scores(spark, d):
    """A9, P8."""
    e = edges(spark, d)
    return A.verdicts(A.window_scores(e.where("split = 'test'"), "max_val_loss", "w"), A.threshold(e.where("split = 'val'"), "nodlink"))


@query("label_idf", "node:l df:l idf:d", "WITH {E} SELECT node, count(DISTINCT w) AS df, ln((SELECT count(DISTINCT w) FROM e WHERE split <> 'test')::DOUBLE / (count(DISTINCT w) + 1)) AS idf FROM ends WHERE split <> 'test' GROUP BY node")
def label_idf(spark, d):
    """A10."""
    return A.idf(P.endpoints(edges(spark, d).where("split <> 'test'"), "w"), "node")


SUMMARY = "lim AS (SELECT w, avg(loss) + 1.5 * stddev_pop(loss) AS lim FROM e WHERE split = 'test' GROUP BY w), an AS (SELECT e.* FROM e JOIN lim ON e.w = lim.w WHERE split = 'test' AND loss > lim)"


@query("anomaly_summary", "w:l n:l mean_loss:d nodes:l", f"WITH {{E}}, {SUMMARY}, nd AS (SELECT w, count(DISTINCT node) AS nodes FROM (SELECT w, src AS node FROM an UNION SELECT w, dst FROM an) GROUP BY w) SELECT an.w, count(*) AS n, sum(loss) / (count(*) + 1e-11) AS mean_loss, any_value(nodes) AS nodes FROM an JOIN nd ON an.w = nd.w GROUP BY an.w")
def anomaly_summary(spark, d):
    """A11."""
    return A.anomaly_summary(edges(spark, d).where("split = 'test'"))


@query("above_summary", "w:l n:l mean_loss:d", "WITH {E} SELECT w, count(CASE WHEN loss > thr THEN 1 END) AS n, coalesce(avg(CASE WHEN loss > thr THEN loss END), 0) AS mean_loss FROM e, thr WHERE split = 'test' GROUP BY w")
def above_summary(spark, d):
    """A12."""
    e = edges(spark, d)
    return A.above_summary(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))


#: Queues: windows that share rare nodes of anomalous edges. A queue is named by the place of its first window among such.
QUEUES = SUMMARY + f""", lb AS (SELECT w, split, CASE WHEN node >= 1000000 THEN '/data/f' || node ELSE '/home/u' || node END AS label FROM ends),
    nw AS (SELECT count(DISTINCT CASE WHEN split = 'train' THEN w END)::DOUBLE AS a, count(DISTINCT CASE WHEN split = 'test' THEN w END)::DOUBLE AS b FROM lb),
    df AS (SELECT label, count(DISTINCT CASE WHEN split = 'train' THEN w END) AS x, count(DISTINCT CASE WHEN split = 'test' THEN w END) AS y FROM lb GROUP BY label),
    rare AS (SELECT label FROM df, nw WHERE CASE WHEN x = 0 THEN ln(a) ELSE ln(a / (x + 1)) END + CASE WHEN y = 0 THEN ln(b) ELSE ln(b / (y + 1)) END > 5 AND NOT ({" OR ".join(f"contains(label, '{k}')" for k in BENIGN_KEYWORDS)})),
    al AS (SELECT DISTINCT w, CASE WHEN node >= 1000000 THEN '/data/f' || node ELSE '/home/u' || node END AS label FROM (SELECT w, src AS node FROM an UNION SELECT w, dst FROM an)),
    ov AS (SELECT DISTINCT i.w AS a, k.w AS b FROM al i JOIN rare ON rare.label = i.label JOIN al k ON k.label = i.label WHERE i.w < k.w), ws AS (SELECT DISTINCT w FROM e WHERE split = 'test'),
    rt AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS q FROM ws WHERE w NOT IN (SELECT b FROM ov)), qs AS (SELECT w, q FROM rt UNION SELECT ov.b, qs.q FROM qs JOIN ov ON ov.a = qs.w)"""


def rare_overlap(spark, d):
    """Windows of the test period, and which of them share nodes of anomalous edges that are rare in training and test together."""
    e = edges(spark, d)
    label = F.when(F.col("node") >= 1_000_000, F.concat(F.lit("/data/f"), F.col("node"))).otherwise(F.concat(F.lit("/home/u"), F.col("node"))).alias("label")
    named = lambda split: P.endpoints(e.where(F.col("split") == split), "w").select("w", label)
    found = A.anomalous_nodes(e.where("split = 'test'")).select("w", label)
    rare = A.rare_labels(found, named("train"), named("test"), BENIGN_KEYWORDS)
    return e.where("split = 'test'").select("w").distinct(), A.window_overlap(found.join(rare, "label", "left_semi"), "label")


@query("rare_overlap", "a:l b:l", f"WITH RECURSIVE {{E}}, {QUEUES} SELECT a, b FROM ov")
def rare_overlaps(spark, d):
    """J9, A10, U3, P7."""
    return rare_overlap(spark, d)[1]


@query("queues", "w:l queue:l", f"WITH RECURSIVE {{E}}, {QUEUES} SELECT w, min(q) AS queue FROM qs GROUP BY w")
def queues(spark, d):
    """A window joins the first queue that holds one it overlaps with, which is the least that earlier windows lead back to."""
    return A.queues(*rare_overlap(spark, d))


@query("shared_queues", "w:l queue:l", f"WITH RECURSIVE {{E}}, {QUEUES} SELECT w, q AS queue FROM qs")
def shared_queues(spark, d):
    """Every queue that holds one."""
    return A.queues(*rare_overlap(spark, d), many=True)


@query("queue_verdicts", "w:l y_hat:l", f"""WITH RECURSIVE {{E}}, {QUEUES}, q1 AS (SELECT w, min(q) AS queue FROM qs GROUP BY w), ml AS (SELECT w, coalesce(avg(CASE WHEN loss > thr THEN loss END), 0) AS m FROM e, thr WHERE split = 'test' GROUP BY w),
    sc AS (SELECT queue, sum(ln(m + 1)) AS s FROM q1 JOIN ml ON q1.w = ml.w GROUP BY queue) SELECT w, CASE WHEN s > ln(20) THEN 1 ELSE 0 END AS y_hat FROM q1 JOIN sc ON q1.queue = sc.queue""")
def queue_verdicts(spark, d):
    """A13, E19."""
    members = A.queues(*rare_overlap(spark, d))
    e = edges(spark, d)
    losses = A.above_summary(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))
    return M.queue_verdicts(members, A.queue_scores(members, losses))


@query("group_scores", "day:l score:d", "WITH {E}, s AS (SELECT w, coalesce(avg(CASE WHEN loss > thr THEN loss END), 0) AS m FROM e, thr WHERE split = 'test' GROUP BY w) SELECT w // 24 AS day, ln(product(m + 1)) AS score FROM s GROUP BY 1")
def group_scores(spark, d):
    """Products over the hours of days, as logarithms."""
    e = edges(spark, d)
    losses = A.above_summary(e.where("split = 'test'"), A.threshold(e.where("split = 'val'"), "nodlink"))
    members = losses.select("w", F.floor(F.col("w") / 24).alias("queue"))
    return A.queue_scores(members, losses).select(F.col("queue").alias("day"), F.ln("score").alias("score"))


@query("worst_edges", "node:l event_id:l loss:d", "WITH {E} SELECT node, event_id, loss FROM (SELECT node, event_id, loss, row_number() OVER (PARTITION BY node ORDER BY loss DESC, event_id) AS rn FROM ends WHERE split = 'test') WHERE rn = 1")
def worst_edges(spark, d):
    """A19, E26."""
    return A.worst_edges(edges(spark, d).where("split = 'test'"))


@query("run_stats", "mean:d std:d std_rel:d best:l worst:l", "WITH {E}, r AS (SELECT w // 24 AS run, avg(loss) AS m FROM e GROUP BY 1) SELECT avg(m) AS mean, stddev_pop(m) AS std, stddev_pop(m) / (avg(m) + 1e-12) * 100 AS std_rel, (SELECT run FROM r ORDER BY m DESC, run LIMIT 1) AS best, (SELECT run FROM r ORDER BY m, run LIMIT 1) AS worst FROM r")
def run_stats(spark, d):
    """Days stand for runs."""
    runs = edges(spark, d).groupBy(F.floor(F.col("w") / 24).alias("run")).agg(F.avg("loss").alias("m"))
    return A.run_stats(runs, "m")


@query("run_counters", "split:s type:s malicious:l benign:l first_window:l", "WITH {E} SELECT split, CASE WHEN node >= 1000000 THEN 'file' ELSE 'subject' END AS type, count(DISTINCT CASE WHEN node IN (SELECT node FROM truth) THEN node END) AS malicious, count(DISTINCT CASE WHEN node NOT IN (SELECT node FROM truth) THEN node END) AS benign, min(CASE WHEN node IN (SELECT node FROM truth) THEN w END) AS first_window FROM ends GROUP BY 1, 2")
def run_counters(spark, d):
    """A27."""
    e = edges(spark, d)
    rows = P.flagged(P.endpoints(e, "split", "w").distinct(), truth(e), "node", "y").withColumn("type", F.when(F.col("node") >= 1_000_000, "file").otherwise("subject"))
    bad = F.col("y") == 1
    return rows.groupBy("split", "type").agg(F.countDistinct(F.when(bad, F.col("node"))).alias("malicious"), F.countDistinct(F.when(~bad, F.col("node"))).alias("benign"), F.min(F.when(bad, F.col("w"))).alias("first_window"))


@query("classifier_evaluation", "tp:l fp:l fn:l tn:l precision:d recall:d fpr:d fscore:d accuracy:d balanced_accuracy:d mcc:d lr_plus:d dor:d", """WITH {E}, c AS (SELECT count(CASE WHEN y = 1 AND y_hat = 1 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN y = 0 AND y_hat = 1 THEN 1 END)::DOUBLE AS fp, count(CASE WHEN y = 1 AND y_hat = 0 THEN 1 END)::DOUBLE AS fn, count(CASE WHEN y = 0 AND y_hat = 0 THEN 1 END)::DOUBLE AS tn FROM pred)
    SELECT tp, fp, fn, tn, round(tp / (tp + fp + 1e-12), 5) AS precision, round(tp / (tp + fn + 1e-12), 5) AS recall, round(fp / (fp + tn + 1e-12), 7) AS fpr, round(2 * (tp / (tp + fp + 1e-12)) * (tp / (tp + fn + 1e-12)) / (tp / (tp + fp + 1e-12) + tp / (tp + fn + 1e-12) + 1e-12), 5) AS fscore,
    round((tp + tn) / (tp + tn + fp + fn + 1e-12), 5) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 5) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 5) AS mcc,
    round(tp / (tp + fn + 1e-12) / (fp / (fp + tn + 1e-12) + 1e-12), 5) AS lr_plus, round(tp * tn / (fp * fn + 1e-12), 5) AS dor FROM c""")
def classifier_evaluation(spark, d):
    """E1, E4, F24."""
    return M.classifier_evaluation(predictions(spark, d))


@query("roc_auc", "auc:d", "WITH {E}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM pred) SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r")
def roc_auc(spark, d):
    """E2."""
    return M.roc_auc(predictions(spark, d))


@query("average_precision", "ap:d", "WITH {E}, s AS (SELECT score, sum(y) AS p, count(*) AS n FROM pred GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM s) SELECT sum(p * tp / k::DOUBLE) / sum(p) AS ap FROM c")
def average_precision(spark, d):
    """E3."""
    return M.average_precision(predictions(spark, d))


RANKED = "rk AS (SELECT node, y, y_hat, score, row_number() OVER o AS rank, sum(y) OVER o AS tp, sum(1 - y) OVER o AS fp FROM pred WINDOW o AS (ORDER BY score DESC, node DESC ROWS UNBOUNDED PRECEDING))"


@query("ranked_predictions", "node:l rank:l tp:l fp:l", f"WITH {{E}}, {RANKED} SELECT node, rank, tp, fp FROM rk")
def ranked_predictions(spark, d):
    """W6."""
    return M.ranked(predictions(spark, d))


@query("adp", "adp:d", f"""WITH {{E}}, {RANKED}, fi AS (SELECT attack, min(rank) AS rank FROM rk JOIN truth ON rk.node = truth.node GROUP BY attack), c AS (SELECT tp / rank::DOUBLE AS p, (SELECT count(*) FROM fi WHERE fi.rank <= rk.rank) / (SELECT count(DISTINCT attack) FROM truth)::DOUBLE AS q FROM rk),
    m AS (SELECT p, max(q) AS q FROM c GROUP BY p), s AS (SELECT p, q, coalesce(lag(p) OVER (ORDER BY p), 0) AS p0, coalesce(lag(q) OVER (ORDER BY p), 0) AS q0 FROM m) SELECT sum((p - p0) * (q + q0) / 2) AS adp FROM s""")
def adp(spark, d):
    """E5."""
    return M.adp(predictions(spark, d), attacks(spark, d))


@query("recall_precision_area", "area:d", f"WITH {{E}}, {RANKED}, m AS (SELECT tp / rank::DOUBLE AS p, max(tp / (SELECT sum(y) FROM pred)::DOUBLE) AS q FROM rk GROUP BY 1), s AS (SELECT p, q, coalesce(lag(p) OVER (ORDER BY p), 0) AS p0, coalesce(lag(q) OVER (ORDER BY p), 0) AS q0 FROM m) SELECT sum((p - p0) * (q + q0) / 2) AS area FROM s")
def recall_precision_area(spark, d):
    """E6."""
    return M.recall_precision_area(predictions(spark, d))


SCALED = "s AS (SELECT node, y, score / ((SELECT max(score) FROM pred) + 1e-6) AS s FROM pred), b AS (SELECT avg(s) AS b FROM (SELECT s FROM s WHERE y = 0 ORDER BY s DESC LIMIT 10))"


@query("discrimination", "attack:l score:d", f"WITH {{E}}, {SCALED} SELECT attack, CASE WHEN max(s) IS NULL THEN 0 ELSE greatest(max(s), 0) - any_value(b) END AS score FROM truth LEFT JOIN s ON truth.node = s.node CROSS JOIN b GROUP BY attack")
def discrimination(spark, d):
    """E7, O2."""
    return M.discrimination(predictions(spark, d), attacks(spark, d))


@query("discrimination_hits", "attack:l tp:l", f"WITH {{E}}, {SCALED} SELECT attack, count(CASE WHEN s > b THEN 1 END) AS tp FROM truth LEFT JOIN s ON truth.node = s.node CROSS JOIN b GROUP BY attack")
def discrimination_hits(spark, d):
    """E8."""
    return M.discrimination_hits(predictions(spark, d), attacks(spark, d))


@query("attack_hits", "attack:l tp:l", "WITH {E} SELECT attack, count(CASE WHEN y_hat = 1 THEN 1 END) AS tp FROM truth LEFT JOIN pred ON truth.node = pred.node GROUP BY attack")
def attack_hits(spark, d):
    """E11."""
    return M.attack_hits(predictions(spark, d), attacks(spark, d))


@query("leading_hits", "attack:l tps:l", f"WITH {{E}}, {RANKED} SELECT attack, count(*) AS tps FROM rk JOIN (SELECT node, min(attack) AS attack FROM truth GROUP BY node) a ON rk.node = a.node WHERE fp = 0 AND y = 1 GROUP BY attack")
def leading_hits(spark, d):
    """W7, E12."""
    return M.leading_hits(predictions(spark, d), attacks(spark, d))


@query("until_all_attacks", "tp:l fp:l", f"WITH {{E}}, {RANKED}, l AS (SELECT max(r) AS r FROM (SELECT min(rank) AS r FROM rk JOIN truth ON rk.node = truth.node GROUP BY attack)) SELECT count(CASE WHEN y = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 THEN 1 END) AS fp FROM rk, l WHERE rank < r")
def until_all_attacks(spark, d):
    """E9."""
    return M.until_all_attacks(predictions(spark, d), attacks(spark, d))


@query("false_in_malicious_windows", "ratio:d", "WITH {E}, f AS (SELECT p.node, (SELECT min(w) FROM ends WHERE split = 'test' AND ends.node = p.node AND loss = p.score) AS ww FROM pred p WHERE y = 0 AND y_hat = 1), b AS (SELECT DISTINCT w FROM ends WHERE split = 'test' AND node IN (SELECT node FROM truth)) SELECT avg(CASE WHEN ww IN (SELECT w FROM b) THEN 1.0 ELSE 0.0 END) AS ratio FROM f")
def false_in_malicious_windows(spark, d):
    """E10."""
    e = edges(spark, d)
    bad = P.endpoints(e.where("split = 'test'"), "w").join(truth(e).select("node").distinct(), "node", "left_semi").select("w")
    return M.false_in_malicious_windows(predictions(spark, d), bad)


@query("two_means", "node:l y_hat:l", """WITH {E}, t AS (SELECT node, score, row_number() OVER (ORDER BY score DESC, node) AS rn FROM pred QUALIFY rn <= 30), g AS (SELECT a.rn, sum(b.score) * sum(b.score) / count(*) AS g FROM t a JOIN t b ON b.rn <= a.rn GROUP BY a.rn), h AS (SELECT a.rn, sum(b.score) * sum(b.score) / count(*) AS g FROM t a JOIN t b ON b.rn > a.rn GROUP BY a.rn),
    best AS (SELECT g.rn FROM g JOIN h ON g.rn = h.rn ORDER BY g.g + h.g DESC, g.rn LIMIT 1) SELECT pred.node, CASE WHEN t.rn <= best.rn THEN 1 ELSE 0 END AS y_hat FROM pred CROSS JOIN best LEFT JOIN t ON pred.node = t.node""")
def two_means(spark, d):
    """W16, E13."""
    return M.two_means(predictions(spark, d), 30)


@query("relaxed", "tp:l fp:l fn:l precision:d recall:d f1:d", """WITH {E}, l AS (SELECT src AS a, dst AS b FROM e WHERE split = 'test' UNION SELECT dst, src FROM e WHERE split = 'test'),
    t0 AS (SELECT node FROM pred WHERE y = 1), t1 AS (SELECT node FROM t0 UNION SELECT b FROM l JOIN t0 ON a = node), t2 AS (SELECT node FROM t1 UNION SELECT b FROM l JOIN t1 ON a = node),
    h0 AS (SELECT node FROM pred WHERE y = 1 AND y_hat = 1), h1 AS (SELECT node FROM h0 UNION SELECT b FROM l JOIN h0 ON a = node), h2 AS (SELECT node FROM h1 UNION SELECT b FROM l JOIN h1 ON a = node),
    c AS (SELECT count(CASE WHEN y = 1 AND (y_hat = 1 OR node IN (SELECT node FROM h2)) THEN 1 END)::DOUBLE AS tp, count(CASE WHEN y = 0 AND y_hat = 1 AND node NOT IN (SELECT node FROM t2) THEN 1 END)::DOUBLE AS fp, count(CASE WHEN y = 1 AND y_hat = 0 AND node NOT IN (SELECT node FROM h2) THEN 1 END)::DOUBLE AS fn FROM pred)
    SELECT tp, fp, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c""")
def relaxed(spark, d):
    """Within two hops."""
    return M.relaxed(predictions(spark, d), edges(spark, d).where("split = 'test'"))


@query("threshold_curve", "i:l tp:l fp:l fn:l tn:l", """WITH {E}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM pred), g AS (SELECT i, lo + (hi - lo) * i / 299 AS thr FROM m, (SELECT unnest(range(0, 300)) AS i))
    SELECT i, count(CASE WHEN y = 1 AND score > thr THEN 1 END) AS tp, count(CASE WHEN y = 0 AND score > thr THEN 1 END) AS fp, count(CASE WHEN y = 1 AND score <= thr THEN 1 END) AS fn, count(CASE WHEN y = 0 AND score <= thr THEN 1 END) AS tn FROM g, pred GROUP BY i""")
def threshold_curve(spark, d):
    """E15, E22."""
    from pyspark.sql import Window

    c = M.threshold_curve(predictions(spark, d))
    return c.withColumn("i", F.row_number().over(Window.orderBy("threshold")) - 1)


@query("best_epoch", "epoch:l", "WITH {E} SELECT epoch FROM (SELECT w // 24 AS epoch, round(avg(loss), 0) AS a, round(max(loss), 1) AS b FROM e GROUP BY 1) ORDER BY a DESC, b DESC, epoch LIMIT 1")
def best_epoch(spark, d):
    """Days stand for epochs."""
    stats = edges(spark, d).groupBy(F.floor(F.col("w") / 24).alias("epoch")).agg(F.round(F.avg("loss"), 0).alias("adp"), F.round(F.max("loss"), 1).alias("discrimination"))
    return M.best_epoch(stats)


@query("detection_cost", "current_score:d full_score:d campaign_score:d fp_current:l fp_full:l fp_campaign:l", """WITH {E}, a AS (SELECT min(CASE WHEN y = 1 AND y_hat = 1 THEN score END) AS c0, min(CASE WHEN y = 1 THEN score END) AS c1 FROM pred), c AS (SELECT min(s) AS c2 FROM (SELECT max(score) AS s FROM pred JOIN truth ON pred.node = truth.node GROUP BY attack))
    SELECT c0 AS current_score, c1 AS full_score, c2 AS campaign_score, (SELECT count(*) FROM pred WHERE y = 0 AND score >= c0) AS fp_current, (SELECT count(*) FROM pred WHERE y = 0 AND score >= c1) AS fp_full, (SELECT count(*) FROM pred WHERE y = 0 AND score >= c2) AS fp_campaign FROM a, c""")
def detection_cost(spark, d):
    """A26."""
    out = M.detection_cost(predictions(spark, d), attacks(spark, d))
    return out.withColumnsRenamed({c: f"{c}_score" for c in ("current", "full", "campaign")})


@query("discrimination_area", "area:d", """WITH {E}, k AS (SELECT sum(y) AS k FROM pred), r AS (SELECT y, score, row_number() OVER (PARTITION BY y ORDER BY score DESC, node) AS rn FROM pred),
    x AS (SELECT g.rn, g.score AS bad, b.score AS good, g.score - b.score AS dd FROM r g JOIN r b ON g.rn = b.rn, k WHERE g.y = 1 AND b.y = 0 AND g.rn <= k), n AS (SELECT count(CASE WHEN bad > good THEN 1 END) AS above, greatest(max(bad), max(good)) - least(min(bad), min(good)) AS span FROM x),
    z AS (SELECT dd, row_number() OVER (ORDER BY rn) AS i, count(*) OVER () AS m FROM x, n WHERE above = 0 OR bad > good) SELECT (sum(dd) - sum(CASE WHEN i = 1 THEN dd / 2 ELSE 0 END + CASE WHEN i = m THEN dd / 2 ELSE 0 END)) / (any_value(span) * any_value(k)) AS area FROM z, n, k""")
def discrimination_area(spark, d):
    """W19."""
    return M.discrimination_area(predictions(spark, d))


@query("seen_scores", "is_seen:l y:l n:l mean:d", "WITH {E} SELECT CASE WHEN node IN (SELECT node FROM ends WHERE split = 'train') THEN 1 ELSE 0 END AS is_seen, y, count(*) AS n, avg(score) AS mean FROM pred GROUP BY 1, 2")
def seen_scores(spark, d):
    """E21."""
    p = P.flagged(predictions(spark, d), P.endpoints(edges(spark, d).where("split = 'train'")), "node", "is_seen")
    return p.groupBy("is_seen", "y").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


@query("label_quality", "quality:l n:l tp:l fp:l auc:d", """WITH s AS (SELECT quality, toxic AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)), r AS (SELECT quality, y, score, rank() OVER (PARTITION BY quality ORDER BY score) + (count(*) OVER (PARTITION BY quality, score) - 1) / 2.0 AS r FROM s)
    SELECT quality, count(*) AS n, count(CASE WHEN y = 1 AND score > 1000 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND score > 1000 THEN 1 END) AS fp, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY quality""")
def label_quality(spark, d):
    """E1, E2 by group."""
    rows = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id").select("quality", F.col("toxic").alias("y"), F.col("n_chars").cast("double").alias("score"))
    counts = M.confusion(rows.withColumn("y_hat", (F.col("score") > 1000).cast("int")), "quality").withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    parts = None
    for q in (0, 1):
        one = M.roc_auc(rows.where(F.col("quality") == q)).withColumn("quality", F.lit(q))
        parts = one if parts is None else parts.unionByName(one)
    return counts.join(F.broadcast(parts), "quality")

"""Detection metrics as aggregates and running sums over ranked predictions.

Predictions are rows (node, score, y, y_hat). Running sums over all ranks would be one task's work: they are
taken over one row per distinct score, or within ranges of scores whose offsets are summed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import fraction, mcc
from auditloom.operators.ranks import ranged, running, with_previous


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    n = lambda y, p: F.count(F.when((F.col("y") == y) & (F.col("y_hat") == p), 1))
    return rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))


def classifier_evaluation(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, precision, recall, fpr, f-score, accuracy, balanced accuracy, MCC, LR+ and DOR; ratios by an epsilon of 1e-12.

    Without positives all counts of the ratios are one.
    """
    c = confusion(rows, *by)
    none = (F.col("tp") + F.col("fn")) == 0
    tp, fp, fn, tn = (F.when(none, 1).otherwise(F.col(x)) for x in ("tp", "fp", "fn", "tn"))
    eps = 1e-12
    precision, recall, fpr = tp / (tp + fp + eps), tp / (tp + fn + eps), fp / (fp + tn + eps)
    fnr = 1 - recall
    r = lambda x, n=5: F.round(x, n)
    tnr = fraction(F.col("tn"), F.col("tn") + F.col("fp"))
    tpr = fraction(F.col("tp"), F.col("tp") + F.col("fn"))
    balanced = F.when(tnr.isNull(), tpr).when(tpr.isNull(), tnr).otherwise((tnr + tpr) / 2)
    return c.select(
        *by, "tp", "fp", "fn", "tn", r(precision).alias("precision"), r(recall).alias("recall"), r(fpr, 7).alias("fpr"),
        r(2 * precision * recall / (precision + recall + eps)).alias("fscore"), r((tp + tn) / (tp + tn + fp + fn + eps)).alias("accuracy"),
        r(balanced).alias("balanced_accuracy"), r(mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))).alias("mcc"),
        r(recall / (fpr + eps)).alias("lr_plus"), r((tp * tn) / (fp * fn + eps)).alias("dor"),
    )


def by_score(rows: DataFrame) -> DataFrame:
    """One row per distinct score: its positives and negatives, and those above it; ranges of scores are summed side by side."""
    each = rows.groupBy("score").agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("n"))
    # 64 ranges between the least and greatest score; totals of ranges are few.
    span = each.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    cut = each.crossJoin(F.broadcast(span)).withColumn("part", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 64)).otherwise(0))
    above = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    offsets = offsets.select("part", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("op"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("on_"))
    inside = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(F.broadcast(offsets), "part").select("score", "p", "n", (F.col("op") + F.sum("p").over(inside)).alias("tp"), (F.col("on_") + F.sum("n").over(inside)).alias("fp"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row `auc`: ties count half; null if a class is missing."""
    c = by_score(rows)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2.0)
    return c.agg(F.try_divide(area, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """One row `ap`: the sum of steps of recall times precision, by distinct score."""
    c = by_score(rows)
    return c.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p").cast("double")).alias("ap"))


def ranked(rows: DataFrame) -> DataFrame:
    """Ranks by (score desc, node desc) with running tp and fp; ranges of ranks are summed side by side, and `__p` is the range."""
    order = [F.col("score").desc(), F.col("node").desc()]
    y = F.col("y").cast("long")
    return running(ranged(rows, *order), order, {"rank": F.lit(1).cast("long"), "tp": y, "fp": 1 - y})


def _area(points: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoids over points in the order of x, from (0, 0) on; x is distinct."""
    step = with_previous(points, x, x, y)
    x0, y0 = F.coalesce(f"{x}_0", F.lit(0.0)), F.coalesce(f"{y}_0", F.lit(0.0))
    return step.agg(F.coalesce(F.sum((F.col(x) - x0) * (F.col(y) + y0) / 2), F.lit(0.0)).alias("area"))


def adp(rows: DataFrame, attacks: DataFrame) -> DataFrame:
    """E5: one row `adp`: the area under the share of attacks that are hit, by precision; the best of each precision counts.

    attacks: (node, attack). Shares and precisions are in 0..1.
    """
    at = ranked(rows)
    firsts = at.where("y = 1").join(attacks, "node").groupBy("attack").agg(F.min("rank").alias("rank"))
    hits = firsts.groupBy("rank").agg(F.count("*").alias("hit"))
    total = attacks.agg(F.countDistinct("attack").alias("attacks"))
    curve = running(at.join(hits, "rank", "left"), [F.col("rank")], {"found": F.coalesce("hit", F.lit(0))}).crossJoin(F.broadcast(total))
    points = curve.select((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("found") / F.col("attacks")).alias("detected"))
    return _area(points.groupBy("precision").agg(F.max("detected").alias("detected")), "precision", "detected").withColumnRenamed("area", "adp")


def recall_precision_area(rows: DataFrame) -> DataFrame:
    """The same for recall."""
    at = ranked(rows)
    total = rows.agg(F.sum("y").alias("positives"))
    points = at.crossJoin(F.broadcast(total)).select((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")).alias("recall"))
    return _area(points.groupBy("precision").agg(F.max("recall").alias("recall")), "precision", "recall")


def _against_benign(rows: DataFrame, k: int) -> DataFrame:
    """rows with `s`, the score over the greatest one plus 1e-6, and `benign`, the mean of the k best benign ones."""
    top = rows.agg(F.max("score").alias("__top"))
    scaled = rows.crossJoin(F.broadcast(top)).withColumn("s", F.col("score") / (F.col("__top") + 1e-6)).drop("__top")
    benign = scaled.where("y = 0").orderBy(F.col("s").desc(), "node").limit(k).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("benign"))
    return scaled.crossJoin(F.broadcast(benign))


def discrimination(rows: DataFrame, attacks: DataFrame, k: int = 10) -> DataFrame:
    """(attack, score): the best scaled score of an attack, at least 0, less the mean of the k best benign ones; attacks without rows score 0."""
    found = attacks.join(_against_benign(rows, k).select("node", "s", "benign"), "node", "left")
    return found.groupBy("attack").agg(F.coalesce(F.greatest(F.max("s"), F.lit(0.0)) * F.max(F.when(F.col("s").isNotNull(), 1.0)) - F.max("benign"), F.lit(0.0)).alias("score"))


def discrimination_hits(rows: DataFrame, attacks: DataFrame, k: int = 10) -> DataFrame:
    """(attack, tp): nodes of each attack whose scaled score is above the mean of the k best benign ones; attacks without any count 0."""
    found = attacks.join(_against_benign(rows, k).select("node", "s", "benign"), "node", "left")
    return found.groupBy("attack").agg(F.count(F.when(F.col("s") > F.col("benign"), 1)).alias("tp"))


def attack_hits(rows: DataFrame, attacks: DataFrame) -> DataFrame:
    """(attack, tp): nodes of each attack that are predicted; attacks without any count 0."""
    return attacks.join(rows.where("y_hat = 1").select("node", F.lit(1).alias("hit")), "node", "left").groupBy("attack").agg(F.count("hit").alias("tp"))


def leading_hits(rows: DataFrame, attacks: DataFrame) -> DataFrame:
    """(attack, tps): positives that rank before the first false one, by the least attack of each."""
    own = attacks.groupBy("node").agg(F.min("attack").alias("attack"))
    return ranked(rows).where("fp = 0 and y = 1").join(own, "node").groupBy("attack").agg(F.count("*").alias("tps"))


def until_all_attacks(rows: DataFrame, attacks: DataFrame) -> DataFrame:
    """One row (tp, fp): counts of the ranks before that which completes the set of attacks."""
    at = ranked(rows)
    last = at.where("y = 1").join(attacks, "node").groupBy("attack").agg(F.min("rank").alias("rank")).agg(F.max("rank").alias("last_"))
    before = at.crossJoin(F.broadcast(last)).where("rank < last_")
    return before.agg(F.count(F.when(F.col("y") == 1, 1)).alias("tp"), F.count(F.when(F.col("y") == 0, 1)).alias("fp"))


def false_in_malicious_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """One row `ratio`: of false positives the share whose worst window is malicious; null without any."""
    known = windows.select("w").distinct().withColumn("bad", F.lit(1))
    fp = rows.where("y_hat = 1 and y = 0").join(known, rows["worst_window"] == known["w"], "left")
    return fp.agg(F.avg(F.coalesce("bad", F.lit(0))).alias("ratio"))


def two_means(rows: DataFrame, k: int) -> DataFrame:
    """The k best scores split in two where the squared deviations within both are least; y_hat = 1 above.

    In one dimension the best split is a cut of the sorted scores, found from running sums; k bounds them.
    """
    top = rows.orderBy(F.col("score").desc(), "node").limit(k)
    w = Window.orderBy(F.col("score").desc(), "node")
    run, everything = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s, n = F.sum("score").over(run), F.count("*").over(run)
    rest, m = F.sum("score").over(everything) - s, F.count("*").over(everything) - n
    # Squares of all are constant: the best cut has the greatest sum of squared means times sizes.
    cut = top.withColumns({"gain": s * s / n + F.when(m > 0, rest * rest / F.when(m > 0, m)).otherwise(0.0), "rn": n, "m": m})
    best = cut.where("m > 0").agg(F.max_by("rn", F.struct("gain", -F.col("rn"))).alias("at"))
    high = cut.crossJoin(F.broadcast(best)).where("rn <= at").select("node", F.lit(1).alias("hit"))
    return rows.drop("y_hat").join(high, "node", "left").withColumn("y_hat", F.coalesce("hit", F.lit(0))).drop("hit")


def relaxed(rows: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Precision, recall and f1 that forgive false positives near a malicious node and credit misses near a hit."""
    from auditloom.operators.graph import neighbourhood

    near_truth = neighbourhood(edges, rows.where("y = 1").select("node"), hops).withColumn("nt", F.lit(1))
    near_hit = neighbourhood(edges, rows.where("y = 1 and y_hat = 1").select("node"), hops).withColumn("nh", F.lit(1))
    j = rows.join(near_truth, "node", "left").join(near_hit, "node", "left")
    n = lambda rule: F.count(F.when(F.expr(rule), 1))
    c = j.agg(n("y = 1 and (y_hat = 1 or nh = 1)").alias("tp"), n("y = 0 and y_hat = 1 and nt is null").alias("fp"), n("y = 1 and y_hat = 0 and nh is null").alias("fn"))
    p, r = fraction(F.col("tp"), F.col("tp") + F.col("fp")), fraction(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def threshold_curve(rows: DataFrame, points: int = 300) -> DataFrame:
    """(threshold, tp, fp, fn, tn) at evenly spaced thresholds; each row is counted once, in the cell between two of them."""
    span = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("n"))
    at = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)
    # The last threshold below the score: near by division, then by comparison with the thresholds themselves.
    near = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (points - 1))).otherwise(0).cast("int")
    cell = F.when(at(F.col("near") + 1) < F.col("score"), F.col("near") + 1).when(at(F.col("near")) < F.col("score"), F.col("near")).when(at(F.col("near") - 1) < F.col("score"), F.col("near") - 1).otherwise(F.col("near") - 2)
    cells = rows.crossJoin(F.broadcast(span)).withColumn("near", near).groupBy(F.least(cell, F.lit(points - 1)).alias("i")).agg(F.sum(F.col("y").cast("long")).alias("p1"), F.sum(1 - F.col("y").cast("long")).alias("n1"))
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    # One row a threshold from here on.
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(above)
    c = grid.join(cells, "i", "left").select(at(F.col("i")).alias("threshold"), total("p1").alias("tp"), total("n1").alias("fp"), "p", "n")
    return c.select("threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def coverage(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """Nodes (incident, role, node) against attack nodes that are present in the region: truth (node, attack).

    One row: shares of attack nodes that seeds, seeds and connectors, and all roles cover, the share of benign
    nodes in incidents, mean incidents an attack and how many incidents mix attacks; null where undefined.
    """
    ambiguous = truth.groupBy("node").agg(F.countDistinct("attack").alias("k")).where("k > 1").select("node")
    clean = truth.join(ambiguous, "node", "left_anti")
    bad = truth.select("node").distinct().withColumn("bad", F.lit(1))
    level = F.when(F.col("role") == "seed", 0).when(F.col("role") == "connector", 1).otherwise(2)
    best = nodes.groupBy("node").agg(F.min(level).alias("level")).join(bad, "node", "full")
    n = lambda rule: F.count(F.when(F.expr(rule), 1))
    shares = best.agg(fraction(n("bad = 1 and level = 0"), n("bad = 1")).alias("coverage_seeds"), fraction(n("bad = 1 and level <= 1"), n("bad = 1")).alias("coverage_core"), fraction(n("bad = 1 and level <= 2"), n("bad = 1")).alias("coverage_context"), fraction(n("bad is null and level is not null"), n("level is not null")).alias("benign_fraction"))
    touched = nodes.select("incident", "node").distinct().join(clean, "node").select("incident", "attack").distinct()
    pieces = touched.groupBy("attack").agg(F.count("*").alias("k")).agg(F.avg("k").alias("fragmentation"))
    mixed = touched.groupBy("incident").agg(F.count("*").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("mixed"))
    return shares.crossJoin(pieces).crossJoin(mixed)


def best_epoch(stats: DataFrame, rule: str = "adp") -> DataFrame:
    """The row of the best epoch: by adp, then discrimination, then the earliest; or by discrimination."""
    order = [F.col("adp").desc_nulls_last()] if rule == "adp" else []
    return stats.orderBy(*order, F.col("discrimination").desc_nulls_last(), "epoch").limit(1)


def early_stop(rows: DataFrame, patience: int = 3, max_delta: float = 0.1) -> DataFrame:
    """(type, epoch, metric, value, best, waits, stopped) of rows (type, epoch, malicious, f1, auc, tnr), one for each type and epoch.

    A type is judged by f1 if more than 5 % of its nodes are malicious in its first epoch, by auc if some are, else
    by tnr. A better value than all before starts the count of waits anew, as one below the floor (chance, or the
    best less max_delta) does; any other adds a wait, and at `patience` the type stops. Epochs without the metric
    don't count. Only one row an epoch of a type is folded in order.
    """
    first = rows.groupBy("type").agg(F.min_by("malicious", "epoch").alias("share"))
    metric = F.when(F.col("share") > 0.05, "f1").when(F.col("share") > 0, "auc").otherwise("tnr")
    floor = F.when(F.col("share") > 0.05, 2 * F.col("share") / (F.col("share") + 1)).when(F.col("share") > 0, 0.5).otherwise(0.01)
    value = F.when(F.col("metric") == "f1", F.col("f1")).when(F.col("metric") == "auc", F.col("auc")).otherwise(F.col("tnr"))
    judged = rows.join(first, "type").withColumns({"metric": metric, "floor": floor}).withColumn("value", value).where("value is not null")
    steps = judged.groupBy("type", "metric", "floor").agg(F.sort_array(F.collect_list(F.struct("epoch", "value"))).alias("steps"))
    # At the floor f1 still waits, the other metrics don't.
    start = F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("waits"), F.lit(False).alias("stopped"), F.array().cast("array<struct<epoch:bigint,value:double,best:double,waits:int,stopped:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        better = x["value"] > s["best"]
        low = F.when(F.col("metric") == "f1", x["value"] < F.col("floor")).otherwise(x["value"] <= F.col("floor")) | (x["value"] < s["best"] - max_delta)
        best = F.when(~s["stopped"] & better, x["value"]).otherwise(s["best"])
        waits = F.when(s["stopped"], s["waits"]).when(better | low, 0).otherwise(s["waits"] + 1).cast("int")
        stopped = s["stopped"] | (~better & ~low & (waits >= patience))
        row = F.struct(x["epoch"].cast("long").alias("epoch"), x["value"].cast("double").alias("value"), best.alias("best"), waits.alias("waits"), stopped.alias("stopped"))
        return F.struct(best.alias("best"), waits.alias("waits"), stopped.alias("stopped"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = steps.select("type", "metric", F.explode(F.aggregate("steps", start, step, lambda s: s["out"])).alias("r"))
    return folded.select("type", "r.epoch", "metric", "r.value", "r.best", "r.waits", "r.stopped")


def queue_verdicts(members: DataFrame, scores: DataFrame, at: float = 20.0) -> DataFrame:
    """(w, y_hat): windows of queues that score above the threshold."""
    return members.join(scores, "queue").groupBy("w").agg(F.max((F.col("score") > at).cast("int")).alias("y_hat"))


def detection_cost(rows: DataFrame, attacks: DataFrame) -> DataFrame:
    """One row: the least score of a hit, and false positives at it, at full recall, and where each attack is hit once."""
    first = attacks.join(rows.where("y = 1"), "node").groupBy("attack").agg(F.max("score").alias("s")).agg(F.min("s").alias("campaign"))
    at = rows.agg(F.min(F.when((F.col("y") == 1) & (F.col("y_hat") == 1), F.col("score"))).alias("current"), F.min(F.when(F.col("y") == 1, F.col("score"))).alias("full")).crossJoin(first)
    fp = lambda limit: F.count(F.when((F.col("y") == 0) & (F.col("score") >= F.col(limit)), 1))
    return rows.crossJoin(F.broadcast(at)).groupBy("current", "full", "campaign").agg(fp("current").alias("fp_current"), fp("full").alias("fp_full"), fp("campaign").alias("fp_campaign"))


def discrimination_area(rows: DataFrame) -> DataFrame:
    """One row `area`: between the sorted malicious scores and as many of the highest benign ones.

    Trapezoids run over the ranks at which the malicious score is greater, one after the other; if there are none,
    over all ranks, where the area is negative. It is divided by the range of these scores times their number. Ranks
    that lack a benign score drop out. Without malicious rows the area is 0, without a range null.
    """
    total = rows.agg(F.count(F.when(F.col("y") == 1, 1))).first()[0]
    if not total:
        return rows.sparkSession.createDataFrame([(0.0,)], "area double")
    order = [F.col("score").desc(), F.col("node")]

    def place(y: int, name: str) -> DataFrame:
        best = rows.where(F.col("y") == y).orderBy(*order).limit(total).select("score", "node")
        return running(ranged(best, *order), order, {"rn": F.lit(1).cast("long")}).select("rn", F.col("score").alias(name))

    pairs = place(1, "bad").join(place(0, "good"), "rn")
    every = pairs.agg(F.count(F.when(F.col("bad") > F.col("good"), 1)).alias("above"), (F.greatest(F.max("bad"), F.max("good")) - F.least(F.min("bad"), F.min("good"))).alias("span"))
    taken = pairs.crossJoin(F.broadcast(every)).where((F.col("above") == 0) | (F.col("bad") > F.col("good"))).withColumn("d", F.col("bad") - F.col("good"))
    trapezoids = F.sum("d") - (F.min_by("d", "rn") + F.max_by("d", "rn")) / 2
    return taken.agg(F.try_divide(trapezoids, F.max("span") * total).alias("area"))

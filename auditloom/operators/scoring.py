"""From losses of edges to thresholds and verdicts on nodes, edges, windows and queues."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.provenance import endpoints
from auditloom.operators.ranks import quantile


def loss_stats(losses: DataFrame) -> DataFrame:
    """A1: one row: max, mean, percentile_90 and std (of the population)."""
    return losses.agg(F.max("loss").alias("max"), F.avg("loss").alias("mean"), F.lit(quantile(losses, "loss", 0.9)).cast("double").alias("percentile_90"), F.stddev_pop("loss").alias("std"))


def threshold(losses: DataFrame, method: str, contamination: float = 0.01, test: DataFrame | None = None) -> float:
    """A2: a number from validation losses; `magic` takes the mean of test losses, as its authors do."""
    fixed = {"threatrace": 1.5, "flash": 0.53}
    if method in fixed:
        return fixed[method]
    shares = {"nodlink": 0.9, "ocrapt": 1 - contamination}
    how = {"max_val_loss": F.max("loss"), "mean_val_loss": F.avg("loss"), "magic": F.avg("loss")}
    if method in shares:
        value = quantile(losses, "loss", shares[method])
    elif method in how:
        value = (test if method == "magic" and test is not None else losses).agg(how[method].alias("v")).first()["v"]
    else:
        raise ValueError(f"unknown threshold: {method}")
    if value is None:
        raise ValueError("no validation losses")
    return value


def seed_threshold(losses: DataFrame, method: str = "max", percentile: float = 99.0) -> float:
    """The greatest validation loss, or their percentile (0 to 100).

    An error for no rows, no column `loss`, losses that are null, negative or not finite, percentiles out of range
    and methods that aren't known.
    """
    if "loss" not in losses.columns:
        raise ValueError("the column loss is missing")
    if method not in ("max", "percentile"):
        raise ValueError(f"unknown threshold method: {method}")
    if not 0 <= percentile <= 100:
        raise ValueError("the percentile must be between 0 and 100")
    bad = F.col("loss").isNull() | F.isnan("loss") | (F.col("loss") < 0) | (F.col("loss") == float("inf"))
    n, wrong, most = losses.agg(F.count("*"), F.count(F.when(bad, 1)), F.max("loss")).first()
    if not n:
        raise ValueError("validation losses must not be empty")
    if wrong:
        raise ValueError("losses must be finite and not negative")
    return float(most if method == "max" else quantile(losses, "loss", percentile / 100))


def checked_losses(rows: DataFrame) -> DataFrame:
    """P10: an error for losses that are null, negative or not finite."""
    bad = F.col("loss").isNull() | F.isnan("loss") | (F.col("loss") < 0) | (F.col("loss") == float("inf"))
    return rows.withColumn("loss", F.when(bad, F.raise_error(F.lit("losses must be finite and not negative")).cast("double")).otherwise(F.col("loss")))


def seeds(rows: DataFrame, at: float | Column) -> DataFrame:
    """Losses at or above the threshold."""
    return rows.where(F.col("loss") >= at)


def thresholds_per_type(losses: DataFrame, kind: str, y: str, low: float, high: float) -> DataFrame:
    """A3: (kind, contamination, threshold): the quantile 1 - contamination, where contamination is the share of y kept in [low, high].

    The quantile is interpolated between neighbours by rank, as its level differs by group.
    """
    # One row a type, of which there are few.
    level = losses.groupBy(kind).agg(F.greatest(F.lit(low), F.least(F.lit(high), F.avg(y))).alias("contamination")).collect()
    rows = [(r[kind], r["contamination"], quantile(losses.where(F.col(kind).eqNullSafe(F.lit(r[kind]))), "loss", 1 - r["contamination"])) for r in level]
    return losses.sparkSession.createDataFrame(rows, f"{kind} {dict(losses.dtypes)[kind]}, contamination double, threshold double")


def reduced(method: str) -> Column:
    """A5."""
    if method == "magic":
        raise ValueError("magic doesn't reduce losses")
    return F.avg("loss") if method == "mean_val_loss" else F.max("loss")


def node_scores(edges: DataFrame, method: str = "max_val_loss", use_dst: bool = True) -> DataFrame:
    """(node, score, window): its reduced loss, and the first window in which its loss is greatest."""
    rows = endpoints(edges, "loss", "w") if use_dst else edges.select(F.col("src").alias("node"), "loss", "w")
    return rows.groupBy("node").agg(reduced(method).alias("score"), F.min_by("w", F.struct(-F.col("loss"), "w")).alias("worst_window"))


def gated_verdicts(rows: DataFrame, score: str, at: float, gate: str | None = None) -> DataFrame:
    """(node, score, y_hat): the greatest score, and 1 if any row is above the threshold and 0 and, if gated, the gate holds (the type was predicted rightly)."""
    hit = F.col(score) > max(at, 0.0)
    hit = hit & (F.col(gate).cast("int") == 1) if gate else hit
    return rows.groupBy("node").agg(F.max(score).alias("score"), F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("y_hat"))


def window_scores(edges: DataFrame, method: str = "max_val_loss", *by: str) -> DataFrame:
    """A8 (by w and node), A9 (by w)."""
    return edges.groupBy(*by).agg(reduced(method).alias("score"))


def verdicts(rows: DataFrame, at: float | Column) -> DataFrame:
    """y_hat = 1 above the threshold."""
    return rows.withColumn("y_hat", (F.col("score") > at).cast("int"))


def typed_verdicts(rows: DataFrame, thresholds: DataFrame, kind: str) -> DataFrame:
    """By the threshold of the node's type, else by the mean of all."""
    mean = thresholds.agg(F.avg("threshold").alias("__mean"))
    out = rows.join(F.broadcast(thresholds.select(kind, "threshold")), kind, "left").crossJoin(F.broadcast(mean))
    return verdicts(out, F.coalesce("threshold", "__mean")).drop("threshold", "__mean")


def idf(rows: DataFrame, label: str, window: str = "w") -> DataFrame:
    """A10: (label, df, idf): windows with the label, and ln(windows / (df + 1))."""
    n = rows.agg(F.countDistinct(window).alias("n"))
    return rows.groupBy(label).agg(F.countDistinct(window).alias("df")).crossJoin(F.broadcast(n)).select(label, "df", F.ln(F.col("n") / (F.col("df") + 1)).alias("idf"))


def anomaly_summary(edges: DataFrame, sigmas: float = 1.5) -> DataFrame:
    """Of each window its edges above mean + sigmas * std of the window: how many, their mean loss, and their nodes."""
    w = Window.partitionBy("w")
    marked = edges.withColumn("limit_", F.avg("loss").over(w) + sigmas * F.stddev_pop("loss").over(w)).where("loss > limit_")
    stats = marked.groupBy("w").agg(F.count("*").alias("n"), (F.sum("loss") / (F.count("*") + 1e-11)).alias("mean_loss"))
    nodes = marked.select("w", F.explode(F.array("src", "dst")).alias("node")).groupBy("w").agg(F.countDistinct("node").alias("nodes"))
    return stats.join(nodes, "w")


def above_summary(edges: DataFrame, at: float | Column) -> DataFrame:
    """Of each window the number and mean of losses above a threshold, 0 and 0 when there are none."""
    hit = F.when(F.col("loss") > at, F.col("loss"))
    return edges.groupBy("w").agg(F.count(hit).alias("n"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("mean_loss"))


def anomalous_nodes(edges: DataFrame, sigmas: float = 1.5) -> DataFrame:
    """(w, node): nodes of the edges that A11 finds in each window."""
    w = Window.partitionBy("w")
    marked = edges.withColumn("limit_", F.avg("loss").over(w) + sigmas * F.stddev_pop("loss").over(w)).where("loss > limit_")
    return marked.select("w", F.explode(F.array("src", "dst")).alias("node")).distinct()


def rare_labels(labels: DataFrame, train: DataFrame, test: DataFrame | None, keywords: tuple[str, ...], least: float = 5.0, share: float = 0.9) -> DataFrame:
    """Of labels(label) those that are rare and hold no keyword.

    train and test (label, w) tell in how many windows a label occurs. A label that a period lacks has the idf
    ln(windows). With both periods the sum of both must exceed `least`; with train alone its idf must exceed that of
    a label in no window, of `share` of them.
    """
    out, total = labels.select("label").distinct(), F.lit(0.0)
    for i, rows in enumerate(r for r in (train, test) if r is not None):
        n = rows.agg(F.countDistinct("w").alias(f"n{i}"))
        known = idf(rows, "label").select("label", F.col("idf").alias(f"idf{i}"))
        out = out.join(known, "label", "left").crossJoin(F.broadcast(n))
        total = total + F.coalesce(F.col(f"idf{i}"), F.ln(F.col(f"n{i}").cast("double")))
    rule = total > least if test is not None else total > F.ln(F.col("n0") * share)
    # A label is kept apart from ordinary objects by its text.
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.col("label").cast("string"), F.lit(k))
    return out.where(rule & ~hit).select("label")


def window_overlap(rows: DataFrame, label: str = "label") -> DataFrame:
    """(a, b, shared): windows a < b that share labels, and how many; pairs without a common label don't appear.

    Labels should be rare (rare_labels): one that all windows hold would pair them all.
    """
    one = rows.select("w", label).distinct()
    a, b = one.withColumnRenamed("w", "a"), one.withColumnRenamed("w", "b")
    return a.join(b, label).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def queues(windows: DataFrame, overlap: DataFrame, many: bool = False) -> DataFrame:
    """(w, queue): windows in order join the first queue (or, if many, every queue) that holds a window they overlap with, else found one.

    Each step depends on all before it: the fold runs over one row a window and its overlaps, no edges.
    """
    earlier = overlap.groupBy(F.col("b").alias("w")).agg(F.collect_list("a").alias("past"))
    rows = windows.select("w").distinct().join(earlier, "w", "left").withColumn("__all", F.lit(1))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, set[int]] = {}
        out, n = [], 0
        for w, past in sorted(zip(pdf["w"], pdf["past"]), key=lambda x: x[0]):
            found = sorted(set().union(*(held[p] for p in past))) if past is not None and len(past) else []
            if not found:
                found, n = [n], n + 1
            mine = found if many else found[:1]
            held[w] = set(mine)
            out += [(w, q) for q in mine]
        return pd.DataFrame(out, columns=["w", "queue"])

    return rows.groupBy("__all").applyInPandas(fold, "w long, queue long")


def queue_scores(members: DataFrame, losses: DataFrame) -> DataFrame:
    """The product of mean_loss + 1 over a queue's windows."""
    return members.join(losses, "w").groupBy("queue").agg(F.product(F.col("mean_loss") + 1).alias("score"))


def relation_counts(edges: DataFrame, *by: str) -> DataFrame:
    """(node, op, n_in, n_out)."""
    ends = edges.select(*by, "op", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(*by, "e.node", "op").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def class_weights(rows: DataFrame, kind: str, kinds: DataFrame) -> DataFrame:
    """Total / (classes * count), 0 for classes that don't occur."""
    n = rows.groupBy(kind).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    classes = kinds.count()
    return kinds.join(n, kind, "left").crossJoin(F.broadcast(total)).select(kind, F.coalesce(F.try_divide(F.col("total").cast("double"), classes * F.col("n")), F.lit(0.0)).alias("weight"))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean of the vectors of each key, which have one length; null vectors don't count. Tasks send one vector a key."""
    known = rows.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    return known.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias(vector))


def worst_edges(edges: DataFrame) -> DataFrame:
    """Of each node the first edge of greatest loss."""
    return endpoints(edges, "loss", "event_id").groupBy("node").agg(F.min_by("event_id", F.struct(-F.col("loss"), "event_id")).alias("event_id"), F.max("loss").alias("loss"))


def run_stats(runs: DataFrame, metric: str) -> DataFrame:
    """Mean, std, relative std in percent, and the best and worst run."""
    std, mean = F.stddev_pop(metric), F.avg(metric)
    return runs.agg(mean.alias("mean"), std.alias("std"), (std / (mean + 1e-12) * 100).alias("std_rel"), F.min_by("run", F.struct(-F.col(metric), "run")).alias("best"), F.min_by("run", F.struct(metric, "run")).alias("worst"))


def surprise(train: DataFrame, edges: DataFrame) -> DataFrame:
    """A loss without a network: -ln of the smoothed share of an edge's operation between its types, learnt from train."""
    ops = train.select("op").distinct().count()
    each = train.groupBy("src_type", "dst_type", "op").agg(F.count("*").alias("n"))
    pair = train.groupBy("src_type", "dst_type").agg(F.count("*").alias("m"))
    out = edges.join(F.broadcast(each), ["src_type", "dst_type", "op"], "left").join(F.broadcast(pair), ["src_type", "dst_type"], "left")
    share = (F.coalesce("n", F.lit(0)) + 1.0) / (F.coalesce("m", F.lit(0)) + ops)
    return out.withColumn("loss", -F.ln(share)).drop("n", "m")

"""Edges of a provenance graph: selection, direction, labels, and the joins with nodes and ground truth."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000_000
HOUR = 3_600_000_000_000
SPLITS = (("2024-01-21", "train"), ("2024-01-26", "val"))
FLIPPED = ("view", "click")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as edges: event_id, t (ns), user, k, op, loss, split, src, dst, src_type, dst_type.

    Users are subjects, the k of the properties are files; view and click lead from the file to the user.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    split = F.lit("test")
    for day, name in reversed(SPLITS):
        split = F.when(F.col("ts") < F.lit(day).cast("timestamp_ntz"), name).otherwise(split)
    t = F.unix_micros(F.col("ts").cast("timestamp")) * F.lit(1000)
    k = F.get_json_object("props", "$.k").cast("long")
    base = raw.select("event_id", t.alias("t"), (F.col("user_id") + 1).alias("user"), (k + 1_000_000).alias("file"), F.col("event_type").alias("op"), F.col("value").alias("loss"), split.alias("split"))
    return reverse(base, FLIPPED, "user", "file")


def reverse(edges: DataFrame, operations: Iterable[str], subject: str = "src", target: str = "dst") -> DataFrame:
    """Edges with src and dst, swapped for the given operations; types go along."""
    flip = F.col("op").isin(*operations)
    a, b = F.col(subject), F.col(target)
    out = edges.withColumns({"__s": F.when(flip, b).otherwise(a), "__d": F.when(flip, a).otherwise(b), "src_type": F.when(flip, "file").otherwise("subject"), "dst_type": F.when(flip, "subject").otherwise("file")})
    return out.drop(subject, target).withColumnsRenamed({"__s": "src", "__d": "dst"})


def allowed(edges: DataFrame, operations: Sequence[str]) -> DataFrame:
    """P1."""
    return edges.where(F.col("op").isin(*operations))


def not_excluded(edges: DataFrame, operations: Sequence[str]) -> DataFrame:
    """P2."""
    return edges.where(~F.col("op").isin(*operations))


def without_loops(edges: DataFrame) -> DataFrame:
    """P13."""
    return edges.where("src <> dst")


def between(edges: DataFrame, start: int, end: int, strict: bool = False) -> DataFrame:
    """S10 (strict), S11, P15: by time; a filter that reaches the scan."""
    t = F.col("t")
    return edges.where((t > start) & (t < end) if strict else t.between(start, end))


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends are in nodes(node)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def typed(edges: DataFrame, rules: dict[tuple[str, str], Sequence[str]]) -> DataFrame:
    """Only operations that are allowed between the types of the ends."""
    rows = [(a, b, op) for (a, b), ops in rules.items() for op in ops]
    known = edges.sparkSession.createDataFrame(rows, "src_type string, dst_type string, op string")
    return edges.join(F.broadcast(known), ["src_type", "dst_type", "op"], "left_semi")


def triplet_index(edges: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The place of (src_type, dst_type, op) in a list, from 0; unknown ones are 0 as well."""
    rows = [(*rule, i) for i, rule in enumerate(rules)]
    known = edges.sparkSession.createDataFrame(rows, "src_type string, dst_type string, op string, triplet int")
    return edges.join(F.broadcast(known), ["src_type", "dst_type", "op"], "left").withColumn("triplet", F.coalesce("triplet", F.lit(0)))


def endpoints(edges: DataFrame, *keep: str | Column) -> DataFrame:
    """One row for each end of each edge: node, and what is to be kept."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), *keep)


def split_nodes(edges: DataFrame) -> DataFrame:
    """(split, node)."""
    return endpoints(edges, "split").distinct()


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends joined with nodes(node, label); unknown ends drop out."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end)
    return edges


def flagged(rows: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows with 1 where the key is among members(node), else 0."""
    known = members.select(F.col("node").alias(key)).distinct().withColumn("__in", F.lit(1))
    return rows.join(known, key, "left").withColumn(flag, F.coalesce("__in", F.lit(0))).drop("__in")


def malicious_edges(edges: DataFrame, truth: DataFrame, rule: str = "either_node") -> DataFrame:
    """Edges with y by src_node, dst_node, both_nodes or either_node of the ground truth."""
    out = flagged(flagged(edges, truth, "src", "__s"), truth, "dst", "__d")
    s, d = F.col("__s") == 1, F.col("__d") == 1
    y = {"src_node": s, "dst_node": d, "both_nodes": s & d, "either_node": s | d}[rule]
    return out.withColumn("y", y.cast("int")).drop("__s", "__d")


def missing_reverse(edges: DataFrame) -> DataFrame:
    """Edges of which no edge leads back."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return edges.join(back, ["src", "dst"], "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge, and a copy that leads back unless an edge does already."""
    back = missing_reverse(edges)
    swapped = back.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(swapped.select(*edges.columns))

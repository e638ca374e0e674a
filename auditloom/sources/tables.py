"""Readers and writers of scores, labels, ground truth and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.scalars import strict_long
from auditloom.operators.ranks import numbered


def check_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Edge scores as CSV: numbers are read as text and cast strictly, so that no time goes through a float."""
    raw = check_columns(spark.read.csv(path, header=True), "loss", "srcnode", "dstnode", "time", "edge_type")
    return raw.withColumns({"loss": F.col("loss").cast("double"), **{c: strict_long(F.col(c)) for c in ("srcnode", "dstnode", "time", "edge_type")}})


def write_scores(scores: DataFrame, path: str) -> None:
    """Parquet by split and epoch."""
    scores.write.partitionBy("split", "epoch").parquet(path)


def read_ground_truth(spark: SparkSession, path: str, default: str = "threatrace") -> DataFrame:
    """(uuid, label, node_id): lines `uuid,label,id` or a uuid alone; blank lines are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    quoted = F.regexp_extract("value", r'^([^,]*),"?(.*?)"?,([^,]*)$', 0) != ""
    part = lambda i: F.regexp_extract("value", r'^([^,]*),"?(.*?)"?,([^,]*)$', i)
    return raw.select(F.when(quoted, part(1)).otherwise(F.trim("value")).alias("uuid"), F.when(quoted, part(2)).otherwise(default).alias("label"), F.when(quoted, part(3)).try_cast("long").alias("node_id"))


def read_attack_labels(spark: SparkSession, path: str) -> DataFrame:
    """(attack, node): the third column of each file, named by the file; an attack without nodes can't be there, an empty folder is an error."""
    raw = spark.read.csv(path, schema="uuid string, label string, node string").withColumn("attack", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))
    found = raw.where("node is not null and node <> 'node_id'").select("attack", strict_long(F.col("node")).alias("node")).distinct()
    if found.isEmpty():
        raise ValueError("no attack labels")
    return found


def read_complete_labels(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, is_malicious): values are exactly 0 and 1, and each node comes once."""
    raw = check_columns(spark.read.csv(path, header=True), "node_id", "is_malicious")
    if not raw.groupBy("node_id").count().where("count > 1").isEmpty():
        raise ValueError("a node has several labels")
    flag = F.when(F.col("is_malicious").isin("0", "1"), F.col("is_malicious").cast("int")).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("int"))
    return raw.select(strict_long(F.col("node_id")).alias("node_id"), flag.alias("is_malicious"))


def write_windows(edges: DataFrame, path: str) -> None:
    """Edges by window, sorted in files."""
    edges.repartition("w").sortWithinPartitions("w", "t").write.partitionBy("w").parquet(path)


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge list with labels and types of both ends, nodes(node, label, type)."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end), F.col("label").alias(f"{end}Label"), F.col("type").alias(f"{end}Type")), end)
    return edges.select("src", "dst", "srcLabel", "dstLabel", F.col("op").alias("edgeLabel"), "srcType", "dstType")


def window_order(names: DataFrame) -> DataFrame:
    """(name, place): by the number that all digits of a name make."""
    return numbered(names, [F.regexp_replace("name", r"\D", "").try_cast("decimal(38,0)").asc(), F.col("name")], "place")


def offset_union(parts: list[DataFrame]) -> DataFrame:
    """Edges of several datasets under disjoint node ids: each is moved beyond the greatest id before."""
    out, offset = None, 0
    for i, part in enumerate(parts):
        moved = part.withColumns({"src": F.col("src") + offset, "dst": F.col("dst") + offset, "dataset": F.lit(i)})
        out = moved if out is None else out.unionByName(moved)
        top = part.agg(F.max(F.greatest("src", "dst"))).first()[0]
        offset += (top + 1) if top is not None else 0
    return out


def graph_json(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One JSON line a node: its id, type and distinct targets."""
    out = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("targets"))
    return nodes.join(out, "node", "left").select(F.to_json(F.struct("node", "type", F.coalesce("targets", F.array().cast("array<long>")).alias("targets"))).alias("value"))

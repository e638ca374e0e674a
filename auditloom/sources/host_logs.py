"""Host logs with one action of an actor on an object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.scalars import iso_to_ns, short_host

OBJECTS = ("FILE", "FLOW", "PROCESS")


def actions(spark: SparkSession, path: str, host: str, operations: tuple[str, ...]) -> DataFrame:
    """The actions of one host that are kept, from the logs of a path."""
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("pos"))
    return parsed(raw, host, operations)


def parsed(raw: DataFrame, host: str, operations: tuple[str, ...]) -> DataFrame:
    """S9 and the common filters: lines (value, pos) as actions with their place in the log."""
    fixed = F.regexp_replace("value", r"\\\\", "/")
    get = lambda name: F.get_json_object("line", f"$.{name}").alias(name.split(".")[-1])
    lines = raw.select(fixed.alias("line"), "pos")
    names = ("id", "hostname", "action", "object", "actorID", "objectID", "timestamp")
    props = ("image_path", "file_path", "src_ip", "src_port", "dest_ip", "dest_port", "parent_image_path", "command_line", "direction")
    rows = lines.select("pos", *(get(n) for n in names), *(get(f"properties.{p}") for p in props))
    return rows.where((short_host(F.col("hostname")) == host) & F.col("action").isin(*operations))


def host_nodes(rows: DataFrame) -> DataFrame:
    """(uuid, node_type, path, cmd, src_addr, src_port, dst_addr, dst_port): the last record of each counts; missing values stay null."""
    rows = rows.where(F.col("object").isin(*OBJECTS))
    no = F.lit(None).cast("string")
    both = lambda uuid, kind, order, path=no, cmd=no, a=no, b=no, c=no, d=no: F.struct(F.col(uuid).alias("uuid"), F.lit(kind).alias("node_type"), F.struct("pos", F.lit(order)).alias("at"), F.struct(path.alias("path"), cmd.alias("cmd"), a.alias("src_addr"), b.alias("src_port"), c.alias("dst_addr"), d.alias("dst_port")).alias("v"))
    actor = both("actorID", "subject", 0, F.col("image_path"))
    target = F.when(F.col("object") == "FILE", both("objectID", "file", 1, F.col("file_path"))).when(F.col("object") == "FLOW", both("objectID", "netflow", 1, no, no, F.col("src_ip"), F.col("src_port"), F.col("dest_ip"), F.col("dest_port"))).otherwise(both("objectID", "subject", 1, F.col("parent_image_path"), F.col("command_line")))
    ends = rows.select(F.explode(F.array(actor, target)).alias("e")).select("e.*")
    return ends.groupBy("uuid", "node_type").agg(F.max_by("v", "at").alias("v")).select("uuid", "node_type", "v.*")


def host_events(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, op, dst, event_uuid, t): both ends must be known; reads and inbound flows lead to the actor."""
    ids = nodes.select("uuid").distinct()
    known = rows.join(ids.withColumnRenamed("uuid", "actorID"), "actorID", "left_semi").join(ids.withColumnRenamed("uuid", "objectID"), "objectID", "left_semi")
    flip = (F.col("action") == "READ") | ((F.col("object") == "FLOW") & (F.coalesce("direction", F.lit("")) == "inbound"))
    return known.select(F.when(flip, F.col("objectID")).otherwise(F.col("actorID")).alias("src"), F.col("action").alias("op"), F.when(flip, F.col("actorID")).otherwise(F.col("objectID")).alias("dst"), F.col("id").alias("event_uuid"), iso_to_ns(F.col("timestamp")).alias("t"))

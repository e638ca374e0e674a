"""Audit logs in the CDM layout (versions 18 and 20), one JSON record a line, as nodes and events.

Records are picked by substring before anything is parsed; of several records of one identity the last in
the order of the file counts, and ids follow the order in which identities are first seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.scalars import digest
from auditloom.functions.vocabulary import EXCLUDED, REVERSED
from auditloom.operators.ranks import numbered


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line): pos orders the lines of a file; a file is read in one stretch per split."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return raw.select("file", F.struct("file", "block", F.monotonically_increasing_id()).alias("pos"), F.col("value").alias("line"))


def _prefix(version: int, kind: str) -> str:
    return f'{{"datum":{{"com.bbn.tc.schema.avro.cdm{version}.{kind}"'


def _field(version: int, kind: str, path: str) -> Column:
    """A field, unwrapped from its union; the text "null" if it isn't there."""
    base = f"$.datum['com.bbn.tc.schema.avro.cdm{version}.{kind}'].{path}"
    value = F.get_json_object("line", base)
    inner = [F.get_json_object("line", f"{base}.{t}") for t in ("string", "int", "long")]
    plain = F.when(~value.startswith("{"), value)
    return F.coalesce(*inner, plain, F.lit("null"))


def _last(df: DataFrame, *columns: str) -> DataFrame:
    """Of each uuid its last values, the place where it was first seen, and its hash."""
    picked = F.max_by(F.struct(*columns), "pos").alias("v")
    return df.where("uuid <> 'null' and length(uuid) <> 64").groupBy("uuid").agg(picked, F.min("pos").alias("first")).select("uuid", digest(F.col("uuid")).alias("hash_id"), "v.*", "first")


def netflows(log: DataFrame, version: int = 18) -> DataFrame:
    """S1, S6."""
    kind = "NetFlowObject"
    rows = log.where(F.col("line").contains(_prefix(version, kind)))
    names = {"src_addr": "localAddress", "src_port": "localPort", "dst_addr": "remoteAddress", "dst_port": "remotePort"}
    return _last(rows.select("pos", _field(version, kind, "uuid").alias("uuid"), *(_field(version, kind, f).alias(n) for n, f in names.items())), *names)


def subjects(log: DataFrame, version: int = 18) -> DataFrame:
    """The command line may be a text or a union."""
    kind = "Subject"
    rows = log.where(F.col("line").contains(_prefix(version, kind)))
    return _last(rows.select("pos", _field(version, kind, "uuid").alias("uuid"), _field(version, kind, "properties.map.path").alias("path"), _field(version, kind, "cmdLine").alias("cmd")), "path", "cmd")


def files(log: DataFrame, version: int = 18) -> DataFrame:
    """The first of four places that holds a name."""
    kind = "FileObject"
    rows = log.where(F.col("line").contains(_prefix(version, kind)))
    places = ("properties.map.filename", "properties.map.path", "baseObject.properties.map.filename", "baseObject.properties.map.path")
    name = F.coalesce(*(F.nullif(_field(version, kind, p), F.lit("null")) for p in places), F.lit("null"))
    return _last(rows.select("pos", _field(version, kind, "uuid").alias("uuid"), name.alias("path")), "path")


def node_table(net: DataFrame, sub: DataFrame, fil: DataFrame) -> DataFrame:
    """(uuid, hash_id, node_type, index_id), numbered from 0: netflows, subjects and files, each in the order of first sight.

    Ranges of places are numbered side by side.
    """
    parts = [df.select("uuid", "hash_id", F.lit(t).alias("node_type"), F.lit(i).alias("kind"), "first") for i, (df, t) in enumerate(((net, "netflow"), (sub, "subject"), (fil, "file")))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return numbered(every, [F.col("kind"), F.col("first")], "index_id").select("uuid", "hash_id", "node_type", "index_id")


def cdm_events(log: DataFrame, nodes: DataFrame, version: int = 18) -> DataFrame:
    """(src, op, dst, event_uuid, t): events of known subjects on known objects (files before netflows before subjects), reversed where data flow back."""
    rows = log.where(F.col("line").contains(_prefix(version, "Event")))
    uuid = lambda role: F.regexp_extract("line", rf'"{role}":\{{"com\.bbn\.tc\.schema\.avro\.cdm{version}\.UUID":"(.*?)"', 1)
    got = rows.select(
        F.regexp_extract("line", '"type":"(.*?)"', 1).alias("op"), uuid("subject").alias("subject"), uuid("predicateObject").alias("object"),
        F.regexp_extract("line", rf'Event":\{{"uuid":"(.*?)",', 1).alias("event_uuid"), F.regexp_extract("line", '"timestampNanos":(.*?),', 1).try_cast("long").alias("t"),
    ).where(~F.col("op").isin(*EXCLUDED))
    order = F.when(F.col("node_type") == "file", 0).when(F.col("node_type") == "netflow", 1).otherwise(2)
    objects = nodes.groupBy(F.col("uuid").alias("object")).agg(F.min_by("index_id", order).alias("o"))
    known = got.join(nodes.where("node_type = 'subject'").select(F.col("uuid").alias("subject"), F.col("index_id").alias("s")), "subject").join(objects, "object")
    flip = F.col("op").isin(*REVERSED)
    return known.select(F.when(flip, F.col("o")).otherwise(F.col("s")).alias("src"), "op", F.when(flip, F.col("s")).otherwise(F.col("o")).alias("dst"), "event_uuid", "t")


def ingest(spark: SparkSession, path: str, version: int = 18) -> tuple[DataFrame, DataFrame]:
    """(nodes, events) of a folder of logs."""
    log = lines(spark, path)
    nodes = node_table(netflows(log, version), subjects(log, version), files(log, version))
    return nodes, cdm_events(log, nodes, version)

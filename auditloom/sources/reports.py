"""Reports that appear whole or not at all, and records that tell whether what they were made from has changed."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_id(name: Column, content: Column) -> Column:
    """a file by its name and bytes, wherever it lies."""
    return F.sha2(F.concat(F.encode(name, "utf-8"), F.unhex(F.lit("00")), content.cast("binary")), 256)


def source_ids(spark: SparkSession, path: str) -> DataFrame:
    """(name, source_id) of the files below a path."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("name"), content_id(name, F.col("content")).alias("source_id"))


def inventory(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in microseconds) of all files below the paths, by path: one row a file, without contents."""
    rows = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows += [tuple(r) for r in files.select("path", "length", F.unix_micros("modificationTime")).collect()]
    return sorted(rows)


def fingerprint(*parts) -> str:
    """Of settings and inventories, by content."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, allow_nan=False).encode()).hexdigest()


def _system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """Replaces a small JSON file in one step: readers see the old record or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system, at = _system(spark, path)
    temporary = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(temporary)
    out.write(bytearray(json.dumps(record, indent=2, sort_keys=True, allow_nan=False).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(temporary, at, option)


def read_record(spark: SparkSession, path: str) -> dict | None:
    """The record of a path; None if there is none or it can't be read."""
    system, at = _system(spark, path)
    if not system.exists(at):
        return None
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    try:
        return json.loads(text)
    except ValueError:
        return None


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], mark: str) -> dict:
    """Tables in a generation of their own; only when all are written the pointer is set to it."""
    generation = f"generation-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{generation}/{name}.parquet")
    record = {"schema_version": 1, "fingerprint": mark, "generation": generation, "tables": sorted(tables)}
    write_record(spark, f"{folder}/latest.json", record)
    return record


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The last generation that is complete, with all of its tables there."""
    record = read_record(spark, f"{folder}/latest.json")
    if not record:
        return None
    for name in record["tables"]:
        system, at = _system(spark, f"{folder}/{record['generation']}/{name}.parquet/_SUCCESS")
        if not system.exists(at):
            return None
    return record


def cached(spark: SparkSession, folder: str, mark: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of a report: those of the last generation if it was made from the same (by fingerprint), else new ones.

    A making that fails leaves the last generation as it is.
    """
    record = latest(spark, folder)
    if record is None or record["fingerprint"] != mark:
        record = publish(spark, folder, make(), mark)
    return {name: spark.read.parquet(f"{folder}/{record['generation']}/{name}.parquet") for name in record["tables"]}


def save_selection(spark: SparkSession, path: str, epoch: int, method: str, metrics: dict[str, float], scores: str, mark: str) -> dict:
    """Which epoch was selected, from scores that still have the fingerprint `mark`."""
    if isinstance(epoch, bool) or not isinstance(epoch, int) or epoch < 0:
        raise ValueError("no valid epoch was selected")
    if not all(math.isfinite(v) for v in metrics.values()):
        raise ValueError("metrics must be finite")
    if fingerprint(inventory(spark, scores)) != mark:
        raise RuntimeError("scores changed during the evaluation")
    record = {"schema_version": 1, "epoch": epoch, "policy": "detector_best", "selection_method": method, "selection_split": "test", "test_selected": True, "score_fingerprint": mark, "metrics": metrics}
    write_record(spark, path, record)
    return record


def load_selection(spark: SparkSession, path: str, method: str, scores: str) -> dict:
    """The record of a selection; an error if it is missing, of another method, or of scores that have changed."""
    record = read_record(spark, path)
    if record is None:
        raise ValueError(f"no selection at {path}")
    wanted = {"schema_version": 1, "policy": "detector_best", "selection_method": method, "selection_split": "test", "test_selected": True, "score_fingerprint": fingerprint(inventory(spark, scores))}
    epoch = record.get("epoch")
    if any(record.get(k) != v for k, v in wanted.items()) or isinstance(epoch, bool) or not isinstance(epoch, int) or epoch < 0:
        raise ValueError("the selection is invalid or stale")
    return record

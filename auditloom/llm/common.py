"""What several operators share: the shared folder, durable tables, lean Python tasks, and joins that survive hot keys."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.ranks import checkpoint_folder

#: A word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"
#: At most so many keys are ever broadcast as hot ones.
HOT_KEYS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir (see checkpoint_folder)."""
    return f"{checkpoint_folder(spark)}/auditloom-{uuid.uuid4().hex}"


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """df, written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
}


def tidy() -> None:
    """Gives memory back to the system. Workers are reused: what one task leaves behind would add to the next one's needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """df through run, which takes Arrow batches and yields columns by name; schema is `name type, ...`.

    Nothing passes through floating point, so integers beside nulls stay exact. Arrow arrays pass as they are, whatever
    their type; lists are made into the type that the schema names.
    """
    fields = [f.split(" ", 1) for f in schema.split(", ")]

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for columns in run(batches):
                values = [columns[n] for n, _ in fields]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, _ARROW[t]) for v, (_, t) in zip(values, fields)], names=[n for n, _ in fields])
        finally:
            tidy()

    return df.mapInArrow(lean, schema)


def pandas_map(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """df through run in pandas, for columns without nulls; memory is given back at the end of each task."""

    def lean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInPandas(lean, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with one row of facts per key, where a few keys may hold most of the rows.

    facts carries in `count` how many of the rows have the key. Keys above total / HOT_KEYS number at most
    HOT_KEYS, whatever the size of the input, and only those are broadcast; the others meet in a shuffle.
    """
    keys = list(keys)
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    floor = max(1000, total // HOT_KEYS)
    hot = facts.where(F.col(count) > floor)
    hot_keys = hot.select(*keys, F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot_keys), keys, "left")
    cool = marked.where(F.col("__hot").isNull()).drop("__hot").join(facts.where(F.col(count) <= floor), keys, how)
    warm = marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), keys, "inner")
    return cool.unionByName(warm)


def repeated(df: DataFrame, count: str, name: str, most: int = 10_000) -> DataFrame:
    """df with each row `count` times, numbered by `name` from 0; rows that come very often are dealt to many tasks first."""
    few = df.where(F.col(count) <= most).withColumn(name, F.explode(F.expr(f"sequence(0L, {count} - 1)")))
    many = df.where(F.col(count) > most).withColumn("__part", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {most})")))
    many = many.repartition(shuffle_partitions(df.sparkSession))
    return few.unionByName(many.withColumn(name, F.explode(F.expr(f"sequence(__part * {most}, least({count}, (__part + 1) * {most}) - 1)"))).drop("__part"))


def small_or_shuffled(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, which must be durable and narrow, marked for broadcast if it has at most so many rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffles and checkpoints that no frame needs any more; it does so when both heaps are collected."""
    tidy()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()

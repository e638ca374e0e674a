"""Ranks, running sums, neighbours and quantiles over all rows, without one task that orders them all."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values up to which a quantile is taken in one aggregate; beyond, the place of the rank is narrowed by counts.
DIRECT = 1_000_000
BINS = 1024


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, one of the warehouse on a single machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder, so that all that read it see the same rows and a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df in range partitions of the order, with the number `__p` of each. Written down, as another sampling would cut elsewhere."""
    return kept(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))


def running(cut: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """cut (of ranged, by the same order after by) with sums over the rows of the group up to each row, itself included.

    Partitions are summed side by side; only their totals, a few numbers each, are ordered across.
    """
    names = {n: f"__{n}" for n in sums}
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "__p").agg(*(F.sum(c).alias(names[n]) for n, c in sums.items()))
    offsets = totals.select(*by, "__p", *(F.coalesce(F.sum(m).over(before), F.lit(0)).alias(m) for m in names.values()))
    inside = Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.select("*", *(F.sum(c).over(inside).alias(n) for n, c in sums.items()))
    renamed = offsets.withColumnsRenamed({b: f"__by_{b}" for b in by}).withColumnRenamed("__p", "__q")
    match = F.col("__p") == F.col("__q")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    return out.join(F.broadcast(renamed), match).withColumns({n: F.col(n) + F.col(m) for n, m in names.items()}).drop("__q", *names.values(), *(f"__by_{b}" for b in by))


def numbered(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the place of each row in its group, from 0; the order must tell rows apart."""
    cut = ranged(df, *(F.col(b) for b in by), *order)
    return running(cut, order, {name: F.lit(1).cast("long")}, by).withColumn(name, F.col(name) - 1).drop("__p")


def with_previous(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """df with `<column>_0`, the value of each column in the row before by `order`, whose values must be distinct; null for the first."""
    cut = ranged(df, F.col(order))
    inside = Window.partitionBy("__p").orderBy(order)
    last = cut.groupBy("__p").agg(*(F.max_by(c, order).alias(f"__{c}") for c in columns))
    across = last.select(F.col("__p").alias("__q"), *(F.lag(f"__{c}").over(Window.orderBy("__p")).alias(f"__{c}") for c in columns))
    first = F.row_number().over(inside) == 1
    out = cut.select("*", first.alias("__first"), *(F.lag(c).over(inside).alias(f"{c}_0") for c in columns)).join(F.broadcast(across), F.col("__p") == F.col("__q"))
    return out.withColumns({f"{c}_0": F.when(F.col("__first"), F.col(f"__{c}")).otherwise(F.col(f"{c}_0")) for c in columns}).drop("__p", "__q", "__first", *(f"__{c}" for c in columns))


def _at_rank(df: DataFrame, column: str, rank: int, low: float, high: float, direct: int) -> float:
    """The value at a rank from 0 among those in [low, high], `rank` counted from the first of them."""
    while low < high:
        width = (high - low) / BINS
        inside = df.where(F.col(column).between(low, high))
        bins = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        # At most BINS rows, each with the true bounds of its values.
        found = inside.groupBy(bins.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: r["lo"]):
            if rank < r["n"]:
                if r["n"] <= direct:
                    part = df.where(F.col(column).between(r["lo"], r["hi"])).select(column).orderBy(column).collect()
                    return part[rank][0]
                if (r["lo"], r["hi"]) == (low, high):
                    return low if width <= 0 else r["lo"]
                low, high = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return low


def quantile(df: DataFrame, column: str, share: float, direct: int = DIRECT) -> float | None:
    """The quantile of a column, interpolated between neighbours by rank; null values don't count, and without any it is None."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    if n <= direct:
        return values.agg(F.percentile("v", share)).first()[0]
    values = kept(values)
    place = share * (n - 1)
    one = _at_rank(values, "v", math.floor(place), low, high, max(1, direct // 100))
    two = _at_rank(values, "v", math.ceil(place), low, high, max(1, direct // 100))
    return one + (two - one) * (place - math.floor(place))

"""Joins that Spark would plan as nested loops, as equi-joins on buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, gap: int, at: str = "t", keys: Sequence[str] = ()) -> DataFrame:
    """Pairs with |left.at - right.at| <= gap; columns of the right side get the suffix _r.

    Times are cut into cells as wide as the gap; a row meets the rows of its own and both adjacent cells, so
    that each pair is found exactly once.
    """
    renamed = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns})
    cells = left.withColumn("__cell", F.explode(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: F.floor(F.col(at) / gap) + i)))
    other = renamed.withColumn("__cell_r", F.floor(F.col(f"{at}_r") / gap))
    rule = F.col("__cell") == F.col("__cell_r")
    for k in keys:
        rule = rule & (F.col(k) == F.col(f"{k}_r"))
    return cells.join(other, rule).where(F.abs(F.col(at) - F.col(f"{at}_r")) <= gap).drop("__cell", "__cell_r")


def interval_join(points: DataFrame, spans: DataFrame, cell: int, at: str = "t", start: str = "start", end: str = "end", strict: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Points in [start, end], or in (start, end) if strict.

    Spans are cut into cells of the given width, which points join by equality; a span should cover few
    cells. Names of both sides must differ but for keys.
    """
    cut = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    both = points.withColumn("__cell", F.floor(F.col(at) / cell)).join(cut, ["__cell", *keys]).drop("__cell")
    t = F.col(at)
    return both.where((t > F.col(start)) & (t < F.col(end)) if strict else t.between(F.col(start), F.col(end)))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, at: str = "t", backward: bool = True, strict: bool = True) -> DataFrame:
    """Left with the value of the last row of right before it (or the first after it) of the same keys.

    One union, one shuffle by the keys, one sort: no pairs are formed. Of right rows at the same time the
    greatest value counts backward, the least forward.
    """
    order = F.col(at) if backward else -F.col(at)
    # At equal times a strict join sees the left rows first.
    rank = F.lit(0 if strict else 1)
    l = left.withColumns({"__o": order, "__side": rank, "__v": F.lit(None), "__left": F.lit(True)})
    pick = F.max(value) if backward else F.min(value)
    r = right.groupBy(*keys, at).agg(pick.alias("__v")).withColumns({"__o": order, "__side": F.lit(0 if not strict else 1), "__left": F.lit(False)})
    union = l.withColumn("__v", F.col("__v").cast(right.schema[value].dataType)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__o", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last("__v", ignorenulls=True).over(w)
    return union.withColumn(f"{value}_asof", seen).where("__left").drop("__o", "__side", "__v", "__left")


def mismatches(scores: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of counts that tell whether scores and edges match one to one on keys.

    missing: scores without an edge; ambiguous: scores with several; unscored: edges without a score;
    repeated: keys with several scores.
    """
    s = scores.groupBy(*keys).agg(F.count("*").alias("n_s"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("n_e"))
    both = s.join(e, list(keys), "full")
    total = lambda rule, n: F.coalesce(F.sum(F.when(F.expr(rule), F.col(n))), F.lit(0)).cast("long")
    return both.agg(total("n_e is null", "n_s").alias("missing"), total("n_e > 1", "n_s").alias("ambiguous"), total("n_s is null", "n_e").alias("unscored"), F.count(F.when(F.col("n_s") > 1, 1)).alias("repeated"))


def aligned(scores: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with their scores; an error unless each score has exactly one edge and each key one score."""
    bad = mismatches(scores, edges, keys).first()
    if bad["missing"] or bad["ambiguous"] or bad["repeated"]:
        raise ValueError(f"scores don't match edges: {bad.asDict()}")
    return edges.join(scores, list(keys), "left")

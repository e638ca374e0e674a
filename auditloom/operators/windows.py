"""Windows over edges, and operators along time."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators import ranks
from auditloom.operators.provenance import DAY, HOUR, endpoints


def tumbling(edges: DataFrame, size: int = HOUR, at: str = "t", name: str = "w") -> DataFrame:
    """The number of the window of the given length, from the epoch on."""
    return edges.withColumn(name, F.floor(F.col(at) / size).cast("long"))


def sliding(edges: DataFrame, slide: int, length: int) -> DataFrame:
    """Windows every `slide`, of `length` from their start; rows later in a slide than the length drop out."""
    return tumbling(edges, slide).where(F.pmod(F.col("t"), F.lit(slide)) < length)


def days(edges: DataFrame) -> DataFrame:
    return tumbling(edges, DAY, name="day")


def numbered(edges: DataFrame, *by: str) -> DataFrame:
    """`rn`, the place in time of each edge in its group, from 0; ranges of time are numbered side by side."""
    return ranks.numbered(edges, [F.col("t"), F.col("event_id")], "rn", by)


def batches(edges: DataFrame, size: int, *by: str) -> DataFrame:
    """Batches of `size` edges in the order of time."""
    return numbered(edges, *by).withColumn("batch", F.floor(F.col("rn") / size).cast("long"))


def test_mode(edges: DataFrame, most: int = 2001) -> DataFrame:
    """The first edges in time only, for trials."""
    return edges.orderBy("t", "event_id").limit(most)


def batch_digest(cut: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(batch, digest) of batches of bounded size: SHA-256 over the columns of their events in order, as little-endian 64-bit integers."""

    def digest(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rn")[list(columns)].to_numpy(dtype="<i8")
        return pd.DataFrame({"batch": pdf["batch"].iloc[:1], "digest": [hashlib.sha256(rows.tobytes()).hexdigest()]})

    return cut.select("batch", "rn", *(F.col(c).cast("long").alias(c) for c in columns)).groupBy("batch").applyInPandas(digest, "batch long, digest string")


def hybrid_windows(edges: DataFrame, size: int, batch: int = 1024, by: str = "day") -> DataFrame:
    """Windows of whole batches, closed by the first batch whose last edge is more than `size` past the start.

    Only one row a batch is folded in order; edges are joined with the numbers of their windows.
    """
    cut = batches(edges, batch, by)
    ends = cut.groupBy(by, "batch").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch")
        number, start, out = 0, None, []
        for first, last in zip(pdf["first_t"], pdf["last_t"]):
            start = first if start is None else start
            out.append((number, start))
            if last > start + size:
                number, start = number + 1, last
        pdf["hw"], pdf["hw_start"] = [o[0] for o in out], [o[1] for o in out]
        return pdf[[by, "batch", "hw", "hw_start"]]

    kind = dict(edges.dtypes)[by]
    folded = ends.groupBy(by).applyInPandas(fold, f"{by} {kind}, batch long, hw long, hw_start long")
    return cut.join(folded, [by, "batch"])


def unique_pair_parts(edges: DataFrame, by: str) -> DataFrame:
    """T5: a new part begins whenever a pair (src, dst) comes again within the part; `part` counts from 0.

    The part's begin is the greatest predecessor of the same pair so far, which a fold over a group needs.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        seen: set[tuple[int, int]] = set()
        number, out = 0, []
        for pair in zip(pdf["src"], pdf["dst"]):
            if pair in seen:
                seen, number = set(), number + 1
            seen.add(pair)
            out.append(number)
        return pd.DataFrame({"event_id": pdf["event_id"], "part": out})

    parts = edges.select(by, "event_id", "t", "src", "dst").groupBy(by).applyInPandas(fold, "event_id long, part long")
    return edges.join(parts, "event_id")


def grouped_windows(windows: Column, size: int) -> Column:
    """Mini-batches of consecutive windows."""
    return F.floor(windows / size).cast("long")


def fuse(edges: DataFrame, *by: str) -> DataFrame:
    """Of each run of equal operations between two nodes the first edge."""
    w = Window.partitionBy(*by, "src", "dst").orderBy("t", "event_id")
    return edges.withColumn("__op", F.lag("op").over(w)).where("__op is null or __op <> op").drop("__op")


def edge_keys(edges: DataFrame, *by: str) -> DataFrame:
    """The place of each edge among those between the same nodes, from 0."""
    w = Window.partitionBy(*by, "src", "dst").orderBy("t", "event_id")
    return edges.withColumn("key", F.row_number().over(w).cast("long") - 1)


def idle_gaps(edges: DataFrame) -> DataFrame:
    """Of each node the least, greatest and mean gap between its events, its lifespan, and the time it was active."""
    w = Window.partitionBy("node").orderBy("t", "event_id")
    gaps = endpoints(edges, "t", "event_id").withColumn("gap", F.col("t") - F.lag("t").over(w))
    short = gaps.groupBy("node").agg(F.percentile("gap", 0.01).alias("short"))
    stats = gaps.join(short, "node").groupBy("node").agg(
        F.coalesce(F.min("gap"), F.lit(0)).alias("gap_min"), F.coalesce(F.max("gap"), F.lit(0)).alias("gap_max"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_mean"), (F.max("t") - F.min("t")).alias("lifespan"),
        F.coalesce(F.sum(F.when(F.col("gap") <= F.col("short"), F.col("gap"))), F.lit(0)).alias("active"),
    )
    return stats


def versions(edges: DataFrame, *by: str) -> DataFrame:
    """Versions of both ends, so that time alone orders the graph: each edge that arrives at a node makes its next version.

    A source has the version that the edges before it have made, a target that of this edge.
    """
    w = Window.partitionBy(*by, "node").orderBy("t", "event_id", "arrives").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = edges.select(*by, "event_id", "t", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("arrives")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("arrives")))).alias("e"))
    counted = ends.select(*by, "event_id", "t", "e.node", "e.arrives").withColumn("version", F.sum("arrives").over(w))
    picked = counted.groupBy("event_id").agg(F.max(F.when(F.col("arrives") == 0, F.col("version"))).alias("src_version"), F.max(F.when(F.col("arrives") == 1, F.col("version"))).alias("dst_version"))
    return edges.join(picked, "event_id")


def next_window(rows: DataFrame) -> DataFrame:
    """(node, w) with w_end, the next window in which the node occurs; null for the last."""
    return rows.select("node", "w").distinct().withColumn("w_end", F.lead("w").over(Window.partitionBy("node").orderBy("w")))


def first_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the first row."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_per(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """Of each key the first k rows, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def last_neighbours(edges: DataFrame, k: int, batch: str = "batch") -> DataFrame:
    """(batch, node, neighbours): the last k neighbours by event of each node that occurs in a batch, from earlier batches only."""
    ends = edges.select(batch, "event_id", "t", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"))
    ends = ends.select(batch, "event_id", "t", "e.*")
    # Each batch adds its own last k; earlier lists are joined up to k in the order of batches.
    own = top_per(ends.withColumn("__g", F.struct(batch, "node")), "__g", k, F.col("t").desc(), F.col("event_id").desc())
    own = own.groupBy(batch, "node").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "other"))).alias("mine"))
    # The k last lists hold the k last neighbours at least.
    w = Window.partitionBy("node").orderBy(batch).rowsBetween(-k, -1)
    flat = F.flatten(F.collect_list("mine").over(w))
    cut = F.slice(flat, F.greatest(F.size(flat) - k + 1, F.lit(1)), F.lit(k))
    return own.select(batch, "node", F.transform(cut, lambda x: x["other"]).alias("neighbours"))


def last_update(edges: DataFrame) -> DataFrame:
    """(event_id, node, last_t): when each end of an edge was last part of an earlier edge."""
    w = Window.partitionBy("node").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return endpoints(edges, "t", "event_id").distinct().withColumn("last_t", F.max("t").over(w))


def last_message(edges: DataFrame, *by: str) -> DataFrame:
    """Of each group and node the operation of its last edge."""
    return endpoints(edges, *by, "t", "event_id", "op").groupBy(*by, "node").agg(F.max_by("op", F.struct("t", "event_id")).alias("last_op"))


def disorder(edges: DataFrame, by: str = "w") -> DataFrame:
    """Windows that begin before an earlier one has ended."""
    spans = edges.groupBy(by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("past", F.max("hi").over(w)).where("lo < past")


def roots(edges: DataFrame) -> DataFrame:
    """Nodes whose first edge leads away from them."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.min("t").alias("first_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.min("t").alias("first_in"))
    return out.join(into, "node", "left").where("first_in is null or first_out < first_in").select("node")

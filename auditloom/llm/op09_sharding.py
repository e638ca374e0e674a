"""K-d tree sharding: nodes are split at weighted medians along their widest metadata dimension.

Equal texts are one point of the tree, weighted by the bytes of all its copies. Medians are found by histograms
that all tasks fill together, narrowed around the value at which half of the bytes are reached; no node is sorted
or gathered. A node is split until it holds the target bytes; a point too heavy for that is cut through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import durable, join_group_facts, release, repeated, small_or_shuffled, text_or_empty

#: Bins of a node's histogram, and of those of all nodes, at most: what the driver sees at once.
BINS, ALL_BINS = 1024, 1 << 20
#: Cuts move at most this share of a leaf's bytes away from the median; equal texts stay together where that allows it.
SLACK = 0.01
METADATA = ("lang", "source", "n_chars")
#: Distinct values of a text dimension up to which their order is sent to all tasks.
NAMES = 100_000


def _cuts(points: DataFrame, key: Column, goals: dict[int, float], slack: dict[int, float], low: dict[int, int], high: dict[int, int]) -> dict[int, tuple[int, float, float]]:
    """Of each node (v, bytes of keys < v, bytes of keys = v), v being where its bytes reach the goal; or, if a cut after v lies within
    the slack of the goal, (v, all bytes of keys <= v, 0).

    points has `node` and `weight`.
    """
    spark, below, done = points.sparkSession, dict.fromkeys(goals, 0.0), {}
    low, high = dict(low), dict(high)
    bins = max(16, min(BINS, ALL_BINS // max(1, len(goals))))
    while len(done) < len(goals):
        steps = {n: max(1, -(-(high[n] - low[n] + 1) // bins)) for n in goals if n not in done}
        ranges = spark.createDataFrame([(n, low[n], high[n], s) for n, s in steps.items()], "node_ int, low_ long, high_ long, step_ long")
        binned = points.withColumn("key_", key).join(F.broadcast(ranges), F.col("node") == F.col("node_")).where("key_ between low_ and high_")
        counted = binned.groupBy("node_", F.expr("(key_ - low_) div step_").alias("bin")).agg(F.sum("weight").alias("weight")).collect()
        by_node: dict[int, list[tuple[int, float]]] = {n: [] for n in steps}
        for r in counted:
            by_node[r["node_"]].append((r["bin"], float(r["weight"])))
        for n, found in by_node.items():
            last, weight = 0, 0.0
            for last, weight in sorted(found):
                if below[n] + weight >= goals[n]:
                    break
                below[n] += weight
            first, end = low[n] + last * steps[n], min(high[n], low[n] + (last + 1) * steps[n] - 1)
            if goals[n] - below[n] <= slack[n] and first > low[n]:
                done[n] = (first - 1, below[n], 0.0)
            elif below[n] + weight - goals[n] <= slack[n]:
                done[n] = (end, below[n] + weight, 0.0)
            elif first == end or not found:
                done[n] = (first, below[n], weight)
            low[n], high[n] = first, end
    return done


def _kd_tree(points: DataFrame, dims: int, leaves: int) -> DataFrame:
    """points (d1, d2, size, lo, hi, d<i> for each dimension) with `node`, the leaf, 0 to leaves - 1.

    A point stands for the copies lo, ..., hi - 1 of a text; it comes out in several pieces if it is cut through.
    """
    points = points.withColumn("node", F.lit(0))
    nodes, span = {0: leaves}, {}
    names = [f"d{i}" for i in range(3, 3 + dims)]
    weigh = (F.col("size") * (F.col("hi") - F.col("lo"))).cast("double")
    while any(n > 1 for n in nodes.values()):
        points = durable(points.withColumn("weight", weigh))
        found = points.groupBy("node").agg(F.sum("weight").alias("weight"), *(f(c).alias(f"{k}_{c}") for c in [*names, "d1"] for k, f in (("lo", F.min), ("hi", F.max)))).collect()
        bounds = {r["node"]: r for r in found}
        if not bounds:
            return points.drop("weight")
        span = span or {d: max(1, bounds[0][f"hi_{d}"] - bounds[0][f"lo_{d}"]) for d in names}
        goals, axis, slack = {}, {}, {}
        for node, n in nodes.items():
            if n > 1 and node in bounds:
                b = bounds[node]
                axis[node] = max(range(dims), key=lambda i: (b[f"hi_{names[i]}"] - b[f"lo_{names[i]}"]) / span[names[i]])
                goals[node] = b["weight"] * (n // 2) / n
                slack[node] = SLACK * b["weight"] / n
        if not goals:
            return points.drop("weight")
        spark = points.sparkSession
        axes = spark.createDataFrame([(n, a) for n, a in axis.items()], "node int, axis int")
        points = points.join(F.broadcast(axes), "node", "left").withColumn("along", F.element_at(F.array(*names), F.col("axis") + 1)).drop("axis")
        side = lambda k, c: {n: bounds[n][f"{k}_{c(n)}"] for n in goals}
        first = _cuts(points, F.col("along"), goals, slack, *(side(k, lambda n: names[axis[n]]) for k in ("lo", "hi")))
        # A value that is too heavy for either side is cut by the digest, and a text that is, by its copies.
        heavy = {n for n, (_, _, w) in first.items() if w}
        second, cut = {}, {}
        if heavy:
            at = points.join(F.broadcast(spark.createDataFrame([(n, first[n][0]) for n in heavy], "node int, value_ long")), "node").where("along = value_")
            second = _cuts(at, F.col("d1"), {n: goals[n] - first[n][1] for n in heavy}, {n: slack[n] for n in heavy}, *({n: bounds[n][f"{k}_d1"] for n in heavy} for k in ("lo", "hi")))
            cut = {n: goals[n] - first[n][1] - b for n, (_, b, w) in second.items() if w}
        rows = [(n, nodes[n] // 2, first[n][0], n in heavy, second[n][0] if n in heavy else None, cut.get(n)) for n in goals]
        cuts = spark.createDataFrame(rows, "node int, left_ int, v1 long, heavy boolean, v2 long, rest double")
        j = points.join(F.broadcast(cuts), "node", "left")
        on_value = F.col("heavy") & (F.col("along") == F.col("v1"))
        through = on_value & (F.col("d1") == F.col("v2")) & F.col("rest").isNotNull()
        # Of a text that is cut as many copies go left as make up the rest.
        middle = F.when(through, F.least(F.col("hi"), F.col("lo") + F.round(F.col("rest") / F.col("size")).cast("long")))
        goes_left = F.when(on_value, F.col("d1") <= F.col("v2")).otherwise(F.col("along") <= F.col("v1"))
        stays = F.col("left_").isNull() | goes_left
        piece = lambda node, lo, hi: F.struct(node.alias("node"), lo.alias("lo"), hi.alias("hi"))
        right = F.col("node") + F.col("left_")
        parts = F.when(through, F.array(piece(F.col("node"), F.col("lo"), middle), piece(right, middle, F.col("hi")))).otherwise(F.array(piece(F.when(stays, F.col("node")).otherwise(right), F.col("lo"), F.col("hi"))))
        points = j.withColumn("p", F.explode(parts)).select("d1", "d2", "size", *names, F.col("p.node").alias("node"), F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi")).where("lo < hi")
        grown: dict[int, int] = {}
        for node, n in nodes.items():
            grown[node] = n // 2 if n > 1 else n
            if n > 1:
                grown[node + n // 2] = n - n // 2
        nodes = grown
    return points.drop("weight") if "weight" in points.columns else points


def _order(rows: DataFrame, by: Sequence[str], tie: Sequence[str], count: str) -> DataFrame:
    """rows with `start`, the sum of `count` over the rows of the group before each.

    Stretches of a group are summed side by side; there are about as many as a stretch holds rows.
    """
    stretches = max(1, math.isqrt(rows.count()) // 4)
    dealt = rows.withColumn("stretch", F.pmod(F.xxhash64(*tie), F.lit(stretches)).cast("int"))
    sums = dealt.groupBy(*by, "stretch").agg(F.sum(count).alias("n_"))
    before = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "stretch", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    within = Window.partitionBy(*by, "stretch").orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(starts, [*by, "stretch"])
    return joined.withColumn("start", F.col("start_") + F.coalesce(F.sum(count).over(within), F.lit(0))).drop("start_", "stretch")


def kd_shards(docs: DataFrame, target_bytes: float | None = None, leaves: int = 8, text: str = "text", key: str = "doc_id", dims: Sequence[str] = METADATA) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: each cut halves the bytes of a node along its widest dimension, relative to that of all,
    until nodes hold target_bytes, or, if that isn't given, until there are so many leaves. Dimensions are those of
    dims that docs has (texts by their order, numbers as they are, null before all others), and the bytes of the
    text. Copies of a text, for which its least metadata stand, share a shard; only where a text is so heavy that a
    cut would otherwise move more than SLACK of a shard, its copies are divided. Null texts count as empty, of size
    1. Keys may be null or repeat. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    sha = F.sha2(text_or_empty(text), 256)
    # 120 bits as two integers, neither of which is negative: differences of these don't overflow.
    digest = [F.conv(F.substring(sha, i, 15), 16, 10).cast("long").alias(n) for n, i in (("d1", 1), ("d2", 16))]
    used = [d for d in dims if d in docs.columns]
    kinds = dict(docs.dtypes)
    given = docs.select(F.col(key).alias("id"), *digest, size.alias("size"), F.crc32(text_or_empty(text).cast("binary")).alias("crc"), *(F.col(d).alias(f"m_{d}") for d in used))
    # Equal rows fold into one with their number, and texts into points, before anything else is done.
    folded = durable(given.groupBy("id", "d1", "d2", "size", "crc").agg(F.count("*").alias("n"), *(F.min(f"m_{d}").alias(f"m_{d}") for d in used)))
    points = folded.groupBy("d1", "d2", "size").agg(F.sum("n").alias("hi"), *(F.min(f"m_{d}").alias(f"m_{d}") for d in used))
    points = durable(points.withColumn("lo", F.lit(0).cast("long")))
    coded = points
    for i, d in enumerate(used):
        if kinds[d] == "string":
            names = points.select(F.col(f"m_{d}").alias("v_")).where("v_ is not null").distinct()
            order = durable(names.withColumn("c_", F.row_number().over(Window.orderBy("v_")).cast("long")))
            coded = coded.join(small_or_shuffled(order, NAMES), F.col(f"m_{d}") == F.col("v_"), "left").withColumn(f"d{i + 3}", F.coalesce("c_", F.lit(0).cast("long"))).drop("v_", "c_")
        else:
            coded = coded.withColumn(f"d{i + 3}", F.coalesce(F.col(f"m_{d}").cast("long"), F.lit(-1).cast("long")))
    coded = coded.withColumn(f"d{len(used) + 3}", F.col("size")).drop(*(f"m_{d}" for d in used))
    if target_bytes is not None:
        total = points.agg(F.coalesce(F.sum(F.col("size") * F.col("hi")), F.lit(0))).first()[0]
        leaves = max(1, math.ceil(total / target_bytes - 1e-9))
    tree = durable(_kd_tree(coded, len(used) + 1, leaves).select("d1", "d2", "lo", "hi", F.col("node").alias("shard")))
    release(spark)
    pieces = tree.groupBy("d1", "d2").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("pieces"), F.max("hi").alias("copies"))
    rows = folded.select("id", "d1", "d2", "size", "crc", "n")
    whole = join_group_facts(rows, durable(pieces), ["d1", "d2"], "copies")
    one = whole.where(F.size("pieces") == 1).select("id", "d1", "d2", "size", "crc", "n", F.element_at("pieces", 1).getField("shard").alias("shard"))
    # Rows of texts that are divided take their places among the copies, and each shard gets its stretch of them.
    cut = durable(whole.where(F.size("pieces") > 1))
    placed = _order(cut.select("id", "d1", "d2", "size", "crc", "n", "pieces"), ["d1", "d2"], ["id"], "n")
    end = F.col("start") + F.col("n")
    shares = placed.withColumn("p", F.explode(F.filter("pieces", lambda p: (p["lo"] < end) & (p["hi"] > F.col("start")))))
    shares = shares.select("id", "d1", "d2", "size", "crc", (F.least("p.hi", end) - F.greatest("p.lo", F.col("start"))).alias("n"), F.col("p.shard").alias("shard"))
    dealt = durable(one.unionByName(shares))
    slots = repeated(_order(dealt, ["shard"], ["id", "d1", "d2"], "n"), "n", "nth")
    return slots.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Leaves of an eighth of all bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0]
    return kd_shards(docs, target_bytes=max(1, total or 1) / 8)

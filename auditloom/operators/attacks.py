"""Synthetic events: mimicry around an attack, and unauthorised file access by processes that the network reaches.

All choices are hashes of what is chosen for and a seed, so that reruns agree and no task depends on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import digest
from auditloom.operators import graph, ranks, windows

# The operations of one mimicry action, in order.
PATTERNS = (
    ("EVENT_OPEN", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_READ", "EVENT_READ", "EVENT_READ", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_READ", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_WRITE", "EVENT_WRITE", "EVENT_READ", "EVENT_WRITE", "EVENT_WRITE"),
    ("EVENT_OPEN", "EVENT_READ", "EVENT_READ", "EVENT_READ", "EVENT_READ"),
    ("EVENT_OPEN", "EVENT_WRITE", "EVENT_WRITE", "EVENT_WRITE", "EVENT_WRITE"),
)
#: Steps of an action lie at most so many nanoseconds apart.
MOST_BIAS = 3_000_000_000


def _drawn(n: Column, *what: Column | str) -> Column:
    """A number below n, by hash."""
    return F.pmod(F.xxhash64(*what), n)


def mimicry(edges: DataFrame, processes: DataFrame, files: DataFrame, truth: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(action, step, subject, file, src, dst, op, t, uuid): at least n events of whole actions by processes that an attack reaches.

    edges (src, dst, t) are those of the attack's time, truth(node) its nodes. Roots are nodes of the attack that act
    before anything arrives among its own edges; processes(node) that they reach along growing times, themselves
    included, act at times at which they have events, on any of files(node). Reads go from the file to the process.
    Without roots, processes or files the result is empty.
    """
    spark = edges.sparkSession
    bad = truth.select("node").distinct()
    own = edges.join(bad.withColumnRenamed("node", "src"), "src", "left_semi").join(bad.withColumnRenamed("node", "dst"), "dst", "left_semi")
    roots = windows.roots(own).select("node").withColumn("t", F.lit(-(1 << 62)).cast("long"))
    reached = graph.temporal_reachable(edges, roots, 1000).select("node").join(processes.select("node"), "node", "left_semi")
    acts = edges.select(F.col("src").alias("node"), "t").unionByName(edges.select(F.col("dst").alias("node"), "t")).join(reached, "node", "left_semi").select("node", "t")
    moments = ranks.kept(acts.withColumn("moment", F.row_number().over(Window.partitionBy("node").orderBy("t")).cast("long") - 1))
    counts = moments.groupBy("node").agg(F.count("*").alias("times"))
    who = ranks.kept(ranks.numbered(counts.withColumnRenamed("node", "subject"), [F.col("subject")], "who"))
    which = ranks.kept(ranks.numbered(files.select(F.col("node").alias("file")).distinct(), [F.col("file")], "which"))
    people, things = who.count(), which.count()
    if not people or not things:
        return spark.createDataFrame([], "action long, step int, subject long, file long, src long, dst long, op string, t long, uuid string")
    patterns = F.array(*(F.array(*map(F.lit, p)) for p in PATTERNS))
    seeded = F.lit(seed)
    # n bounds the actions, each of which has two events at least.
    picked = spark.range((n + 1) // 2).select(F.col("id").alias("action"), _drawn(F.lit(people), "id", F.lit("who"), seeded).alias("who"), _drawn(F.lit(things), "id", F.lit("file"), seeded).alias("which"), F.element_at(patterns, (_drawn(F.lit(len(PATTERNS)), "id", F.lit("pattern"), seeded) + 1).cast("int")).alias("ops"))
    before = Window.orderBy("action").rowsBetween(Window.unboundedPreceding, -1)
    taken = picked.withColumn("sofar", F.coalesce(F.sum(F.size("ops")).over(before), F.lit(0))).where(F.col("sofar") < n).drop("sofar")
    named = taken.join(who, "who").join(which, "which").withColumn("moment", _drawn(F.col("times"), "action", F.lit("time"), seeded))
    timed = named.join(moments.withColumnRenamed("node", "subject"), ["subject", "moment"])
    steps = timed.select("action", "subject", "file", "t", F.posexplode("ops").alias("step", "op")).withColumn("bias", _drawn(F.lit(MOST_BIAS + 1), "action", "step", F.lit("bias"), seeded))
    so_far = Window.partitionBy("action").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.withColumn("t", F.col("t") + F.sum("bias").over(so_far))
    read = F.col("op") == "EVENT_READ"
    ends = [F.when(read, F.col(a)).otherwise(F.col(b)).alias(n_) for n_, a, b in (("src", "file", "subject"), ("dst", "subject", "file"))]
    return out.select("action", "step", "subject", "file", *ends, "op", "t", digest(F.concat(F.col("subject").cast("string"), F.col("file").cast("string"), F.col("t").cast("string"))).alias("uuid"))


def unauthorised(edges: DataFrame, nodes: DataFrame, processes: int, files: int, attacks: int, arrives: str = "EVENT_RECVFROM", seed: int = 0) -> DataFrame:
    """(split, w, process, src, dst, op, t): access of processes to files that they never touch.

    edges (split, w, src, dst, op, t) hold the splits train and val, nodes (node, type) types subject, file and
    netflow. So many processes that `arrives` reaches in both splits open, read and write up to `files` files of the
    window that they have no edge to, and connect to one of its netflows, in their first `attacks` windows of each
    split that offer such files. Steps begin at a time within the window and lie its mean gap (in seconds) apart.
    No process that both splits reach is an error.
    """
    kind = lambda k: nodes.where(F.col("type") == k).select("node")
    subjects = edges.where(F.col("op") == arrives).join(kind("subject").withColumnRenamed("node", "dst"), "dst", "left_semi").select("split", F.col("dst").alias("process")).distinct()
    both = subjects.where("split = 'train'").select("process").intersect(subjects.where("split = 'val'").select("process"))
    chosen = ranks.kept(both.orderBy(F.xxhash64("process", F.lit(seed)), "process").limit(processes))
    if chosen.isEmpty():
        raise RuntimeError("no process is reached in both splits")
    chosen = F.broadcast(chosen)  # at most `processes` rows
    ends = edges.select("split", "w", F.explode(F.array("src", "dst")).alias("node")).distinct()
    there = ends.join(chosen, F.col("node") == F.col("process")).select("split", "w", "process")
    touched = edges.join(chosen, F.col("src") == F.col("process")).select("process", F.col("dst").alias("file")).distinct()
    offered = there.join(ends.join(kind("file"), "node", "left_semi").withColumnRenamed("node", "file"), ["split", "w"]).join(touched, ["process", "file"], "left_anti")
    first = Window.partitionBy("process", "split").orderBy("w")
    held = offered.withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= attacks)
    pick = Window.partitionBy("process", "split", "w").orderBy(F.xxhash64("process", "w", "file", F.lit(seed)), "file")
    some = held.withColumn("i", F.row_number().over(pick) - 1).where(F.col("i") < files).select("split", "w", "process", "file", "i")
    facts = edges.groupBy("split", "w").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    mean = F.coalesce(F.try_divide((F.col("hi") - F.col("lo")) / 1e9, F.col("n") - 1), F.lit(0.0))
    timed = some.join(facts, ["split", "w"]).withColumn("gap", mean).withColumn("begin", F.col("lo") + _drawn(F.col("hi") - F.col("lo") + 1, "process", "w", F.lit(seed)))
    at = lambda steps: (F.col("begin") + F.round(steps * F.col("gap")).cast("long")).alias("t")
    step = F.posexplode(F.array(*map(F.lit, ("EVENT_OPEN", "EVENT_READ", "EVENT_WRITE")))).alias("k", "op")
    access = timed.select("*", step).select("split", "w", "process", F.col("process").alias("src"), F.col("file").alias("dst"), "op", at(F.col("i") * 2 + F.col("k")))
    flows = ends.join(kind("netflow"), "node", "left_semi")
    last = timed.groupBy("split", "w", "process", "begin", "gap").agg(F.max("i").alias("i"))
    one = last.join(flows, ["split", "w"]).groupBy("split", "w", "process", "begin", "gap", "i").agg(F.min_by("node", F.struct(F.xxhash64("process", "w", "node", F.lit(seed)), "node")).alias("node"))
    connect = one.select("split", "w", "process", F.col("process").alias("src"), F.col("node").alias("dst"), F.lit("EVENT_CONNECT").alias("op"), at(F.col("i") * 2 + 3))
    return access.unionByName(connect)

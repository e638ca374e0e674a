"""From verdicts back to attack subgraphs, and the slices that a viewer asks for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import contains_any, severity
from auditloom.operators import graph, strong
from auditloom.operators.provenance import endpoints
from auditloom.operators.windows import top_per


def importance(edges: DataFrame, scores: DataFrame | None, how: str) -> DataFrame:
    """(node, importance) by degree, recon_loss (scores(node, score)) or degree_recon, their product."""
    degree = graph.degree_ratio(edges).withColumnRenamed("ratio", "importance")
    if how == "degree":
        return degree
    loss = scores.select("node", F.col("score").alias("importance"))
    if how == "recon_loss":
        return loss
    return degree.join(loss.withColumnRenamed("importance", "__l"), "node").select("node", (F.col("importance") * F.col("__l")).alias("importance"))


def trace(edges: DataFrame, points: DataFrame, scores: DataFrame | None = None, method: str = "component", how: str = "degree", hops: int = 3) -> DataFrame:
    """(poi, node): what matters around points of interest, per method.

    component: from the ancestor of no incoming edges that matters most on average down to the point and on to
    the exit of no outgoing edges that does; shortest_path: the shortest of such paths; k_hop: the
    neighbourhood.
    """
    if method == "k_hop":
        poi = points.select("node")
        seen = poi.select(F.col("node").alias("poi"), "node")
        links = graph.both_ways(edges)
        for _ in range(hops):
            seen = seen.unionByName(seen.join(links, seen["node"] == links["src"]).select("poi", F.col("dst").alias("node"))).distinct()
        return seen
    of, links = strong.quotient(edges)
    weight = importance(edges, scores, how).groupBy("node").agg(F.max("importance").alias("importance"))
    weighed = graph._kept(of.join(weight, "node", "left").select("node", "q", "end", F.coalesce("importance", F.lit(0.0)).alias("importance")))
    sums = graph._kept(weighed.groupBy("q").agg(F.count("*").alias("n"), F.sum("importance").alias("s")))
    at = graph._kept(points.select(F.col("node").alias("poi")).distinct().join(weighed, F.col("poi") == F.col("node")).join(sums, "q").select("poi", "q", "end", F.when(F.col("end"), F.lit(1)).otherwise(F.col("n")).alias("n"), F.when(F.col("end"), F.col("importance")).otherwise(F.col("s")).alias("s")))
    plain = links.withColumnsRenamed({"a": "src", "b": "dst"})
    found = points.select(F.col("node").alias("poi"), "node")
    for forward in (False, True):
        tips = edges.select(F.col("dst" if forward else "src").alias("node")).join(edges.select(F.col("src" if forward else "dst").alias("node")), "node", "left_anti").distinct()
        # Of a class of ends all have the same nodes before them, so that the one that matters most stands for it.
        best = weighed.join(tips, "node").groupBy("q").agg(F.max(F.struct("importance", -F.col("node"))).alias("m")).select("q", F.col("m.importance").alias("e"), (-F.col("m.col2")).alias("tip"))
        best = graph._kept(best)
        reached = graph._kept(graph.closure(plain, at.select(F.col("q").alias("node")), forward).select(F.col("root").alias("q"), F.col("node").alias("x")))
        # A point that is an end itself has no other one.
        pairs = graph._kept(reached.join(best.select(F.col("q").alias("x"), "e", "tip"), "x").where("q <> x").select("q", F.col("x").alias("tq"), "e", "tip"))
        back = graph.closure(plain, pairs.select(F.col("tq").alias("node")), not forward).select(F.col("root").alias("tq"), F.col("node").alias("x"))
        between = graph._kept(pairs.select("q", "tq").join(back, "tq").where("x <> q and x <> tq").join(reached, ["q", "x"], "left_semi"))
        inner = between.join(sums.withColumnRenamed("q", "x"), "x").groupBy("q", "tq").agg(F.sum("n").alias("__n"), F.sum("s").alias("__s"))
        mean = (F.col("s") + F.coalesce("__s", F.lit(0.0)) + F.col("e")) / (F.col("n") + F.coalesce("__n", F.lit(0)) + 1)
        each = at.join(pairs, "q").join(inner, ["q", "tq"], "left").withColumn("m", mean)
        top = graph._kept(each.groupBy("poi").agg(F.max(F.struct("m", -F.col("tip"), "q", "tq", "end")).alias("t")).select("poi", (-F.col("t.col2")).alias("tip"), "t.q", "t.tq", "t.end"))
        if method == "component":
            parts = top.join(between, ["q", "tq"]).select("poi", F.col("x").alias("q")).unionByName(top.where("not end").select("poi", "q"))
            found = found.unionByName(parts.join(of, "q").select("poi", "node")).unionByName(top.select("poi", F.col("tip").alias("node")))
        else:
            found = found.unionByName(shortest(edges, top.select("poi", F.col("tip").alias("end")), forward))
    return found.distinct()


def shortest(edges: DataFrame, ends: DataFrame, forward: bool, rounds: int = 1000) -> DataFrame:
    """(poi, node): nodes of the shortest path between the point and its end, of equal ones that of least nodes; rounds end when no end is left to find.

    The search starts at the ends, which many points share, and leaves at each node the least next one on a
    shortest way; points then follow these.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = graph._kept(edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct())
    ends = graph._kept(ends.select("poi", "end").distinct())
    left = ends.where("poi <> end")
    front = ends.select("end", F.col("end").alias("node"), F.lit(None).cast("long").alias("next")).distinct()
    seen, n = graph._kept(front), 0
    while not left.isEmpty():
        if n == rounds:
            raise RuntimeError("a shortest path takes more rounds than allowed")
        n += 1
        step = front.join(left.select("end").distinct(), "end", "left_semi").join(links, F.col("node") == F.col("__b"))
        front = graph._kept(step.groupBy("end", F.col("__a").alias("node")).agg(F.min("node").alias("next")).join(seen.select("end", "node"), ["end", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = graph._kept(seen.unionByName(front))
        left = graph._kept(left.join(front.select("end", F.col("node").alias("poi")), ["poi", "end"], "left_anti"))
    state = ends.join(left, ["poi", "end"], "left_anti").select("poi", "end", F.col("poi").alias("node"), F.array("poi").alias("path"))
    for _ in range(n):
        moved = state.join(seen, ["end", "node"], "left")
        state = graph._kept(moved.select("poi", "end", F.coalesce("next", "node").alias("node"), F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path")))
    return state.select("poi", F.explode("path").alias("node"))


def anomaly_subgraphs(edges: DataFrame, anomalous: DataFrame, per_type: int = 10, hops: int = 1, max_edges: int = 5000, least: float | None = None) -> DataFrame:
    """(seed, event_id): events between anomalous(node, type, score) nodes around the top seeds of each type.

    A seed's events beyond max_edges are thinned evenly by operation, by hash, and seeds with the same events
    count once. With `least`, subgraphs whose losses don't sum up to more are left out.
    """
    inner = edges.join(anomalous.select(F.col("node").alias("src")), "src", "left_semi").join(anomalous.select(F.col("node").alias("dst")), "dst", "left_semi")
    tops = top_per(anomalous, "type", per_type, F.col("score").desc(), F.col("node")).select(F.col("node").alias("seed"))
    seen = tops.select("seed", F.col("seed").alias("node"))
    links = graph.both_ways(inner)
    for _ in range(hops):
        seen = seen.unionByName(seen.join(links, seen["node"] == links["src"]).select("seed", F.col("dst").alias("node"))).distinct()
    rows = inner.join(seen.withColumnRenamed("node", "src"), "src").join(seen.withColumnsRenamed({"node": "dst", "seed": "__s"}), "dst").where("seed = __s").select("seed", "event_id", "op")
    w = Window.partitionBy("seed", "op").orderBy(F.xxhash64("event_id"), "event_id")
    n = Window.partitionBy("seed")
    ranked = rows.withColumns({"rn": F.row_number().over(w), "k": F.count("*").over(Window.partitionBy("seed", "op")), "n": F.count("*").over(n)})
    thin = ranked.where((F.col("n") <= max_edges) | (F.col("rn") <= F.floor(F.col("k") * max_edges / F.col("n"))))
    sums = thin.groupBy("seed").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(event_id))").alias("h"))
    keep = sums.groupBy("m", "h").agg(F.min("seed").alias("seed")).select("seed")
    kept = thin.join(keep, "seed", "left_semi").select("seed", "event_id")
    if least is None:
        return kept
    return kept.join(severities(kept, edges).where(F.col("score") > least).select("seed"), "seed", "left_semi")


def severities(subgraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, score, severity) of subgraphs by the sum of their losses."""
    return subgraphs.join(edges.select("event_id", "loss"), "event_id").groupBy("seed").agg(F.sum("loss").alias("score")).withColumn("severity", severity(F.col("score")))


def reevaluated(rows: DataFrame, traced: DataFrame) -> DataFrame:
    """Predictions with y_hat = 1 for the traced nodes only."""
    hit = traced.select("node").distinct().withColumn("hit", F.lit(1))
    return rows.drop("y_hat").join(hit, "node", "left").withColumn("y_hat", F.coalesce("hit", F.lit(0))).drop("hit")


def to_windows(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(w, y, y_hat): a window is what any of its nodes is."""
    return endpoints(edges, "w").distinct().join(rows, "node").groupBy("w").agg(F.max("y").alias("y"), F.max("y_hat").alias("y_hat"))


def node_view(edges: DataFrame, nodes: DataFrame, node: int) -> DataFrame:
    """Events of a node with the partner's label, "" if it is unknown."""
    mine = edges.where((F.col("src") == node) | (F.col("dst") == node)).withColumn("other", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")))
    return mine.join(nodes.withColumnsRenamed({"node": "other"}), "other", "left").withColumn("label", F.coalesce("label", F.lit("")))


def search(rows: DataFrame, text: Column, words: list[str], limit: int) -> DataFrame:
    """Rows that contain any of the words in any case, the first `limit` by node; `capped` tells whether there were more."""
    found = rows.where(contains_any(F.lower(text), [w.lower() for w in words]))
    top = found.orderBy("node").limit(limit + 1).withColumn("rn", F.row_number().over(Window.orderBy("node")))
    return top.withColumn("capped", F.max("rn").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("rn") <= limit).drop("rn")


def attack_pairs(edges: DataFrame, malicious: DataFrame) -> DataFrame:
    """(a, b): pairs of malicious nodes with an edge either way."""
    ids = malicious.select("node").distinct()
    inner = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inner.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def causal(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(root, node, direction) that is reached forward or backward in time from start(node, t)."""
    f = graph.temporal_reach(edges, start, hops).select("root", "node", F.lit("forward").alias("direction"))
    b = graph.temporal_reach(edges, start, hops, forward=False).select("root", "node", F.lit("backward").alias("direction"))
    return f.unionByName(b)


def campaign(edges: DataFrame, malicious: DataFrame, caps: tuple[int, ...] = (500, 300, 200, 100)) -> DataFrame:
    """(node, hop): malicious nodes and what lies within so many hops, each hop limited to its cap by hash."""
    links = graph.both_ways(edges)
    pick = lambda df, k: df.orderBy(F.xxhash64("node"), "node").limit(k)
    seen = pick(malicious.select("node").distinct(), caps[0]).withColumn("hop", F.lit(0))
    front = seen
    for hop, cap in enumerate(caps[1:], 1):
        step = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = graph._kept(pick(step, cap).withColumn("hop", F.lit(hop)))
        seen = graph._kept(seen.unionByName(front))
    return seen


def campaign_edges(edges: DataFrame, malicious: DataFrame, caps: tuple[int, ...] = (500, 300, 200, 100)) -> DataFrame:
    """(src, dst, op, hop): the campaign graph's edges, oriented by (hop, id) of their ends, so that it has no cycles.

    Edges between malicious nodes are hop 0, those that leave what is reached so far come next; each hop is
    limited to its cap by hash, as the reference limits it.
    """
    links = graph._kept(edges.where("src <> dst").select("src", "dst", "op").distinct())
    pick = lambda df, k: df.orderBy(F.xxhash64("src", "dst", "op"), "src", "dst", "op").limit(k)
    within = lambda df, end, nodes, how: df.join(nodes.select(F.col("node").alias(end)), end, how)
    bad = malicious.select("node").distinct()
    kept = graph._kept(pick(within(within(links, "src", bad, "left_semi"), "dst", bad, "left_semi"), caps[0]).withColumn("hop", F.lit(0)).select("src", "dst", "op", "hop"))
    front = seen = graph._kept((bad if kept.isEmpty() else endpoints(kept).distinct()).withColumn("at", F.lit(0)))
    for hop, cap in enumerate(caps[1:], 1):
        out = within(within(links, "src", front, "left_semi"), "dst", seen, "left_anti").select("src", "dst", "op")
        into = within(within(links, "dst", front, "left_semi"), "src", seen, "left_anti").select("src", "dst", "op")
        part = graph._kept(pick(out.unionByName(into), cap).withColumn("hop", F.lit(hop)))
        front = graph._kept(endpoints(part).distinct().join(seen, "node", "left_anti").withColumn("at", F.lit(hop)))
        kept = kept.unionByName(part)
        if front.isEmpty():
            break
        seen = graph._kept(seen.unionByName(front))
    for end in ("src", "dst"):
        kept = kept.join(seen.select(F.col("node").alias(end), F.struct("at", "node").alias(f"__{end}")), end)
    first = kept.groupBy(F.least("__src", "__dst").getField("node").alias("src"), F.greatest("__src", "__dst").getField("node").alias("dst")).agg(F.min(F.struct("hop", "op")).alias("e"))
    return first.select("src", "dst", "e.op", "e.hop")


def slice_of(edges: DataFrame, start: DataFrame, lo: int, hi: int, hops: int) -> DataFrame:
    """Events of the time range between nodes within so many hops of start(node)."""
    part = edges.where(F.col("t").between(lo, hi))
    near = graph.neighbourhood(part, start, hops)
    return part.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def bounded_slice(incidents: DataFrame, most: int) -> DataFrame:
    """Of each incident the first `most` events by role (seeds, connectors, context), then id."""
    order = F.when(F.col("role") == "seed", 0).when(F.col("role") == "connector", 1).otherwise(2)
    return top_per(incidents, "incident", most, order, F.col("event_id")).drop("rank")


def bounded_reference(events: DataFrame, key: str, most_nodes: int, most_edges: int) -> DataFrame:
    """M9: (key, event_id, truncated): of each entry's events (key, event_id, src, dst) in order those that a view can show.

    An event is left out if the view is full, or if its nodes would be too many; `truncated` tells whether any was.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, taken = set(), []
        for event, src, dst in pdf.sort_values("event_id")[["event_id", "src", "dst"]].itertuples(index=False):
            new = {src, dst} - nodes
            if len(taken) < most_edges and len(nodes) + len(new) <= most_nodes:
                taken.append(event)
                nodes |= new
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(taken), "event_id": taken, "truncated": len(taken) < len(pdf)})

    kind = dict(events.dtypes)[key]
    return events.select(key, "event_id", "src", "dst").groupBy(key).applyInPandas(fold, f"{key} {kind}, event_id long, truncated boolean")


def score_histogram(rows: DataFrame, bins: int = 20) -> DataFrame:
    """V7: (bin, n) of scores in equal cells between the least and greatest."""
    span = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.crossJoin(F.broadcast(span)).groupBy(cell.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def smart_sample(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """All malicious nodes(node, y), then benign ones up to `most`, neighbours of malicious ones first, the rest by hash."""
    near = graph.neighbourhood(edges, nodes.where("y = 1").select("node"), 1).withColumn("near", F.lit(1))
    order = nodes.join(near, "node", "left").withColumn("rank_", F.when(F.col("y") == 1, 0).when(F.col("near") == 1, 1).otherwise(2))
    bad = order.where("rank_ = 0")
    return bad.unionByName(order.where("rank_ > 0").orderBy("rank_", F.xxhash64("node"), "node").limit(most)).select("node", "y")


def distinct_vectors(rows: DataFrame, places: int = 6) -> DataFrame:
    """(vec_id, first): the least id of those whose vectors are equal to so many decimal places."""
    rounded = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, places))
    keyed = rows.select("vec_id", F.sha2(F.to_json(rounded), 256).alias("h"))
    return keyed.join(keyed.groupBy("h").agg(F.min("vec_id").alias("first")), "h").select("vec_id", "first")

"""Graph operators as bounded rounds of joins: neighbourhoods, closures, temporal paths, components and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators import ranks, strong, unions

_kept = ranks.kept


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(node) within so many hops of start(node), itself included."""
    links = edges.select("src", "dst").distinct() if directed else both_ways(edges)
    seen = start.select("node").distinct()
    for _ in range(hops):
        step = seen.join(links, seen["node"] == links["src"]).select(F.col("dst").alias("node"))
        seen = seen.unionByName(step).distinct()
    return seen


def closure(edges: DataFrame, start: DataFrame, forward: bool = True, rounds: int = 1000) -> DataFrame:
    """(root, node) that each root(node) reaches, itself included; rounds end when nothing new is found."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = _kept(edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct())
    seen = _kept(start.select(F.col("node").alias("root"), "node").distinct())
    front = seen
    for _ in range(rounds):
        step = front.join(links, front["node"] == links["__a"]).select("root", F.col("__b").alias("node")).distinct()
        front = _kept(step.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = _kept(seen.unionByName(front))
    raise RuntimeError("the closure takes more rounds than allowed")


def reachable(edges: DataFrame, start: DataFrame, forward: bool = True, rounds: int = 1000) -> DataFrame:
    """(node) that any of start(node) reaches, itself included: one row a node, however many starts reach it."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = _kept(edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct())
    seen = front = _kept(start.select("node").distinct())
    for _ in range(rounds):
        step = front.join(links, front["node"] == links["__a"]).select(F.col("__b").alias("node")).distinct()
        front = _kept(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = _kept(seen.unionByName(front))
    raise RuntimeError("the search takes more rounds than allowed")


def reach_counts(edges: DataFrame, start: DataFrame, forward: bool = True, rounds: int = 1000) -> DataFrame:
    """(root, n): how many nodes each root(node) reaches, itself included.

    No rows are made for pairs of nodes: what a root reaches is added up over strongly connected parts and classes of
    nodes that lead to the same parts, or that the same parts lead to. One row is made for each of these that one
    of them reaches, which is few where parts are large, and as many as in `closure` in a graph without cycles
    or such classes.
    """
    of, links = strong.quotient(edges)
    sizes = of.groupBy("q").agg(F.count("*").alias("size"))
    asked = _kept(start.select("node").distinct().join(of, "node", "left").join(sizes, "q", "left"))
    far = closure(links.withColumnsRenamed({"a": "src", "b": "dst"}), asked.where("q is not null").select(F.col("q").alias("node")), forward, rounds).where("root <> node")
    more = far.join(sizes, far["node"] == sizes["q"]).groupBy(F.col("root").alias("q")).agg(F.sum("size").alias("more"))
    own = F.when(F.col("end"), F.lit(1)).otherwise(F.coalesce("size", F.lit(1)))
    return asked.join(more, "q", "left").select(F.col("node").alias("root"), (own + F.coalesce("more", F.lit(0))).alias("n"))


def between_nodes(edges: DataFrame, entry: DataFrame, exit_: DataFrame) -> DataFrame:
    """Nodes on any path from the entries to the exits: descendants of the one and ancestors of the other."""
    return reachable(edges, entry).join(reachable(edges, exit_, forward=False), "node", "left_semi")


def temporal_reach(edges: DataFrame, start: DataFrame, hops: int, forward: bool = True, strict: bool = False) -> DataFrame:
    """(root, node, t): the earliest arrival (backward: the latest departure) from start(node, t) in at most so many hops.

    Times on a path don't decrease (backward: don't increase), or do so strictly. Of each node only the best
    time goes on, since whatever can be reached from a worse one can be from it.
    """
    return _best_times(edges, start.select(F.col("node").alias("root"), "node", "t"), hops, forward, strict)


def temporal_reachable(edges: DataFrame, start: DataFrame, hops: int, forward: bool = True, strict: bool = False) -> DataFrame:
    """(node, t): as temporal_reach, from any of the start: one row a node, however many starts reach it."""
    return _best_times(edges, start.select(F.lit(0).alias("root"), "node", "t"), hops, forward, strict).drop("root")


def _best_times(edges: DataFrame, start: DataFrame, hops: int, forward: bool, strict: bool) -> DataFrame:
    """(root, node, t) from start(root, node, t)."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = _kept(edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col("t").alias("__t")).distinct())
    best = F.min if forward else F.max
    seen = _kept(start.groupBy("root", "node").agg(best("t").alias("t")))
    front = seen
    for _ in range(hops):
        t, u = F.col("t"), F.col("__t")
        rule = ((u > t) if strict else (u >= t)) if forward else ((u < t) if strict else (u <= t))
        step = front.join(links, front["node"] == links["__a"]).where(rule).groupBy("root", F.col("__b").alias("node")).agg(best("__t").alias("t"))
        old = seen.withColumnRenamed("t", "old")
        better = (F.col("t") < F.col("old")) if forward else (F.col("t") > F.col("old"))
        front = _kept(step.join(old, ["root", "node"], "left").where(F.col("old").isNull() | better).drop("old"))
        if front.isEmpty():
            break
        seen = _kept(seen.unionByName(front).groupBy("root", "node").agg(best("t").alias("t")))
    return seen


def searched(links: DataFrame, sources: DataFrame, max_hops: int, budget: int, last: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(start, lo, hi, node, at, cost, hops, path): the best states of searches from sources(start, lo, hi), and those of them that the last round found.

    links: (event_id, __s, __d, __t, __c), of no negative costs. A round keeps the cheapest state of each (start, lo,
    node, arrival), of equal ones that of fewest hops, then of least ids. Nodes of the last round may be confined to
    last(node). More states than the budget in one search are an error, not a missing path.
    """
    states = found = _kept(sources.select("start", "lo", "hi", F.col("start").alias("node"), F.col("lo").alias("at"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array().cast("array<long>").alias("path")))
    key = ["start", "lo", "node", "at"]
    for i in range(max_hops):
        ways = links if last is None or i < max_hops - 1 else links.join(last.select(F.col("node").alias("__d")).distinct(), "__d", "left_semi")
        step = states.join(ways, states["node"] == ways["__s"]).where("__t >= at and __t <= hi")
        step = step.select("start", "lo", "hi", F.col("__d").alias("node"), F.col("__t").alias("at"), (F.col("cost") + F.col("__c")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("event_id")).alias("path"))
        best = step.groupBy(*key, "hi", "hops").agg(F.min(F.struct("cost", "path")).alias("m")).select(*key, "hi", "hops", "m.cost", "m.path")
        old = found.groupBy(*key).agg(F.min("cost").alias("old"))
        states = _kept(best.join(old, key, "left").where("old is null or cost < old").select(*states.columns))
        found = found.unionByName(states)
        most = found.groupBy("start", "lo").count().agg(F.max("count")).first()[0] or 0
        if most > budget:
            raise RuntimeError(f"{most} states of a search exceed the budget of {budget}")
        if states.isEmpty():
            break
    return found, states


def path_links(edges: DataFrame) -> DataFrame:
    """Edges (event_id, src, dst, t, cost) as searched takes them."""
    return _kept(edges.select("event_id", F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("t").alias("__t"), F.col("cost").cast("double").alias("__c")))


def temporal_paths(edges: DataFrame, pairs: DataFrame, max_hops: int, budget: int = 5_000_000, slice_: int = 20_000_000) -> DataFrame:
    """(pair, cost, hops, path): the cheapest path whose times don't decrease, for pairs (pair, start, target, lo, hi).

    edges: (event_id, src, dst, t, cost), of no negative costs. path lists event ids; of equal costs the one of fewest
    hops, then of least ids. Start and target in one node give the empty path. Pairs without a path don't appear. Pairs
    of one start and lo share a search, whose states the budget bounds as in the reference: more of them are an
    error, not a missing path. The last hop is looked up between its ends, without a state for all others. Searches whose
    starts have more than `slice_` edges in all take turns.
    """
    pairs = _kept(pairs.select("pair", "start", "target", "lo", "hi").where("lo <= hi"))
    links = path_links(edges)
    ways = pairs.select("start", "lo").distinct().join(links.groupBy(F.col("__s").alias("start")).agg(F.count("*").alias("n")), "start")
    turns = 1 + (ways.agg(F.sum("n")).first()[0] or 0) // slice_
    done = None
    for i in range(turns):
        # Searches take turns, so that only the states of one turn are held; what a turn leaves are its paths.
        part = pairs if turns == 1 else pairs.where(F.pmod(F.xxhash64("start", "lo"), F.lit(turns)) == i)
        part = _kept(_paths(links, part, max_hops, budget))
        done = part if done is None else done.unionByName(part)
        if turns > 1:
            pairs.sparkSession._jvm.System.gc()  # lets the cleaner drop files of the turn
    return done


def _paths(links: DataFrame, pairs: DataFrame, max_hops: int, budget: int) -> DataFrame:
    """(pair, cost, hops, path) of temporal_paths."""
    found, last = searched(links, pairs.groupBy("start", "lo").agg(F.max("hi").alias("hi")), max(0, max_hops - 1), budget)
    ends = pairs.withColumnRenamed("hi", "__hi")
    done = found.join(ends, ["start", "lo"]).where("node = target and at <= __hi").select("pair", "cost", "hops", "path")
    if max_hops:
        step = last.join(ends, ["start", "lo"]).where("at <= __hi and node <> target")
        step = step.join(links, (F.col("node") == F.col("__s")) & (F.col("target") == F.col("__d"))).where("__t >= at and __t <= __hi")
        done = done.unionByName(step.select("pair", (F.col("cost") + F.col("__c")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("event_id")).alias("path")))
    return done.groupBy("pair").agg(F.min(F.struct("cost", "hops", "path")).alias("m")).select("pair", "m.cost", "m.hops", "m.path")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that links reach; a node that is linked with itself alone is its own."""
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    found = unions.components(ends).select(F.col("id").alias("node"), "component")
    nodes = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    return found.unionByName(nodes.join(found, "node", "left_anti").withColumn("component", F.col("node")))


def spanning_trees(links: DataFrame) -> DataFrame:
    """Of links (component, a, b, weight) those of the minimum spanning tree of each component, ties by (weight, a, b)."""
    return unions.spanning_forest(links)


def pruned(links: DataFrame, protected: DataFrame, rounds: int = 1000) -> DataFrame:
    """Links (a, b) without leaves, and leaves of what is left, that aren't protected(node)."""
    keep = protected.select("node").distinct()
    links = _kept(links.select("a", "b").distinct())
    for _ in range(rounds):
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        leaves = _kept(ends.groupBy("node").agg(F.countDistinct("other").alias("k")).where("k <= 1").join(keep, "node", "left_anti").select("node"))
        if leaves.isEmpty():
            return links
        links = _kept(links.join(leaves.withColumnRenamed("node", "a"), "a", "left_anti").join(leaves.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    raise RuntimeError("pruning takes more rounds than allowed")


def acyclic(edges: DataFrame) -> DataFrame:
    """A graph without cycles: simple edges, no loops, and of a pair that links both ways the later one goes.

    Longer cycles are broken by the order of nodes in time: an edge stays if its source was first seen before
    its target. That keeps all edges that time-respecting growth makes and depends on no scan order.
    """
    simple = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("t").alias("t"))
    seen = edges.select(F.explode(F.array("src", "dst")).alias("node"), "t").groupBy("node").agg(F.min("t").alias("born"))
    j = simple.join(seen.withColumnsRenamed({"node": "src", "born": "sb"}), "src").join(seen.withColumnsRenamed({"node": "dst", "born": "db"}), "dst")
    return j.where("sb < db or (sb = db and src < dst)").select("src", "dst", "t")


def first_edges(edges: DataFrame, *by: str) -> DataFrame:
    """Of each pair of nodes the first edge."""
    return edges.groupBy(*by, "src", "dst").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("event_id"), F.min_by("op", F.struct("t", "event_id")).alias("op"))


def pseudo_root_sizes(edges: DataFrame, roots: DataFrame, most: float = 0.5) -> DataFrame:
    """(root, n): how many edges lead from the pseudo node of each root, to all it reaches, unless these are none or more than `most` of all nodes."""
    total = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").alias("total"))
    reached = reach_counts(edges, roots).select("root", (F.col("n") - 1).alias("n")).where("n > 0")
    return reached.crossJoin(F.broadcast(total)).where(F.col("n") <= most * F.col("total")).select("root", "n")


def pseudo_roots(edges: DataFrame, roots: DataFrame, most: float = 0.5) -> DataFrame:
    """(root, node): the edges of pseudo_root_sizes, which are counted before any is made."""
    few = pseudo_root_sizes(edges, roots, most).select(F.col("root").alias("node"))
    return closure(edges, few).where("root <> node")


def degree_ratio(edges: DataFrame) -> DataFrame:
    """(node, ratio): outgoing over incoming edges; 0 without incoming ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.coalesce(F.try_divide(F.sum("e.o").cast("double"), F.sum("e.i").cast("double")), F.lit(0.0)).alias("ratio"))


def fused_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between fused nodes(node, path, type): of equal paths and types one; the greatest loss of each edge counts."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end), F.concat_ws("|", "type", "path").alias(f"{end}_name")), end)
    return edges.groupBy("src_name", "dst_name").agg(F.max("loss").alias("loss"), F.count("*").alias("n"))


def local_ids(edges: DataFrame, by: str) -> DataFrame:
    """(by, node, local): dense numbers from 0 in the order of nodes, in each group."""
    nodes = edges.select(by, F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.withColumn("local", F.row_number().over(Window.partitionBy(by).orderBy("node")).cast("long") - 1)


def walks(edges: DataFrame, start: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """(walk, nodes): random walks along growing times from start(walk, node, t); the choice of a step is a hash of the walk, step and edge."""
    links = _kept(edges.select("event_id", F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("t").alias("__t")))
    state = start.select("walk", "node", "t", F.array("node").alias("nodes"))
    done = None
    for step in range(length):
        moves = state.join(links, (state["node"] == links["__s"]) & (links["__t"] > state["t"]))
        chosen = moves.groupBy("walk").agg(F.min_by(F.struct("__d", "__t", "nodes"), F.xxhash64("walk", F.lit(step), "event_id", F.lit(seed))).alias("m"))
        ended = state.join(chosen.select("walk"), "walk", "left_anti").select("walk", "nodes")
        done = ended if done is None else done.unionByName(ended)
        state = _kept(chosen.select("walk", F.col("m.__d").alias("node"), F.col("m.__t").alias("t"), F.concat("m.nodes", F.array("m.__d")).alias("nodes")))
    return done.unionByName(state.select("walk", "nodes"))


def temporal_walks(edges: DataFrame, start: DataFrame, length: int, half_life: int | None = None, seed: int = 0) -> DataFrame:
    """(walk, nodes): walks of at most `length` nodes from start(walk, node), forward in time, or backward from nodes that no edge leaves.

    Times grow (backward: fall) strictly. Steps are uniform, or, with a half-life in ns, weighted by exp(-gap /
    half_life); the choice is a hash of the walk, step and edge.
    """
    links = _kept(edges.select("event_id", "src", "dst", "t"))
    lo = links.agg(F.min("t")).first()[0] or 0
    leaves = links.select(F.col("src").alias("node")).distinct()
    out = None
    for ahead, how in ((True, "left_semi"), (False, "left_anti")):
        a, b = ("src", "dst") if ahead else ("dst", "src")
        steps = links.select("event_id", F.col(a).alias("__s"), F.col(b).alias("__d"), F.col("t").alias("__t"))
        state, done = _kept(start.join(leaves, "node", how).select("walk", "node", F.lit(None).cast("long").alias("t"), F.array("node").alias("nodes"))), None
        for step in range(length - 1):
            later = F.col("__t") > F.col("t") if ahead else F.col("__t") < F.col("t")
            moves = state.join(steps, (F.col("node") == F.col("__s")) & (F.col("t").isNull() | later))
            # The least of -ln(u) / weight falls on each edge in proportion to its weight; here as logarithms.
            u = (F.pmod(F.xxhash64("walk", F.lit(step), "event_id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
            gap = (F.col("__t") - F.lit(lo)) * (1 if ahead else -1)
            key = F.ln(-F.ln(u)) + (gap / F.lit(float(half_life)) if half_life else F.lit(0.0))
            chosen = moves.groupBy("walk").agg(F.min_by(F.struct("__d", "__t", "nodes"), F.struct(key, "event_id")).alias("m"))
            path = F.concat("m.nodes", F.array("m.__d")) if ahead else F.concat(F.array("m.__d"), "m.nodes")
            after = _kept(chosen.select("walk", F.col("m.__d").alias("node"), F.col("m.__t").alias("t"), path.alias("nodes")))
            ended = state.join(after.select("walk"), "walk", "left_anti").select("walk", "nodes")
            done = ended if done is None else done.unionByName(ended)
            state = after
        part = state.select("walk", "nodes") if done is None else done.unionByName(state.select("walk", "nodes"))
        out = part if out is None else out.unionByName(part)
    return out


def adjacency_walks(edges: DataFrame, length: int, times: int = 10, seed: int = 0) -> DataFrame:
    """(way, start, i, path): from each node as many walks as `times` its distinct neighbours, of at most `length` steps, ahead along edges and back against them.

    A step takes any neighbour, then any of the operations between the two, whatever their times; choices are hashes,
    and one is looked up by its place, so that no step multiplies rows. path is `start,op,node,op,node...`.
    """
    out = None
    for way, a, b in (("ahead", "src", "dst"), ("back", "dst", "src")):
        each = edges.groupBy(F.col(a).alias("at"), F.col(b).alias("to")).agg(F.sort_array(F.collect_set("op")).alias("ops"))
        links = _kept(each.withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy("to")).cast("long") - 1))
        degrees = _kept(links.groupBy("at").agg(F.count("*").alias("degree")))
        start = degrees.select(F.col("at").alias("start"), F.explode(F.expr(f"sequence(0L, degree * {times} - 1)")).alias("i"))
        state, done = start.select("start", "i", F.col("start").alias("at"), F.col("start").cast("string").alias("path")), None
        for step in range(length):
            drawn = lambda n, what: F.pmod(F.xxhash64(F.lit(way), "start", "i", F.lit(step), F.lit(what), F.lit(seed)), n)  # noqa: E731, B023
            picked = state.join(degrees, "at").withColumn("place", drawn(F.col("degree"), "node")).join(links, ["at", "place"])
            op = F.element_at("ops", (drawn(F.size("ops"), "op") + 1).cast("int"))
            after = _kept(picked.select("start", "i", F.col("to").alias("at"), F.concat_ws(",", "path", op, F.col("to").cast("string")).alias("path")))
            if step:
                ended = state.join(degrees, "at", "left_anti").select("start", "i", "path")
                done = ended if done is None else done.unionByName(ended)
            state = after
        part = state.select("start", "i", "path")
        part = (part if done is None else done.unionByName(part)).withColumn("way", F.lit(way))
        out = part if out is None else out.unionByName(part)
    return out.select("way", "start", "i", "path")

"""Candidate incidents: seeds that belong together, the events that connect them, and their context."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import edge_cost
from auditloom.operators import graph
from auditloom.operators.joins import asof_join, band_join


@dataclass(frozen=True)
class IncidentConfig:
    """Settings, checked when made."""

    max_gap: int = 3_600_000_000_000
    max_hops: int = 3
    ancestry_hops: int = 2
    ancestry_ops: tuple[str, ...] = ()
    context_hops: int = 1
    max_context_edges: int = 100
    max_seed_pairs: int = 1_000_000
    max_search_states: int = 5_000_000
    alpha: float = 1.0
    beta: float = 1.0
    gamma: float = 1.0
    penalties: dict[str, float] = field(default_factory=dict)
    group_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if isinstance(self.group_by, str):
            object.__setattr__(self, "group_by", (self.group_by,))
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(f.default, bool) or not isinstance(f.default, (int, float)):
                continue
            whole = isinstance(f.default, int)
            if isinstance(v, bool) or (whole and not isinstance(v, int)) or not math.isfinite(v) or v < 0:
                raise ValueError(f"{f.name} must be a finite {'integer' if whole else 'number'} of at least 0")
            if f.name in ("max_gap", "max_seed_pairs", "max_search_states") and v == 0:
                raise ValueError(f"{f.name} must be positive")


def nearest_seed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with `near`, the distance in time to the nearest seed on either side, in the same window."""
    marks = seeds.select("w", "t", F.col("t").alias("seed_t"))
    back = asof_join(edges, marks, ["w"], "seed_t", strict=False).withColumnRenamed("seed_t_asof", "before")
    both = asof_join(back, marks, ["w"], "seed_t", backward=False, strict=False)
    far = F.lit((1 << 62))
    return both.withColumn("near", F.least(F.coalesce(F.col("t") - F.col("before"), far), F.coalesce(F.col("seed_t_asof") - F.col("t"), far))).drop("before", "seed_t_asof")


def metadata(columns: list[str], attribute: str) -> Column:
    """I4: of an edge its own attribute where edges have one, else that on which its nodes (src_ and dst_<attribute>) agree; null if they don't or it is unknown."""
    if attribute in columns:
        return F.col(attribute)
    one, two = (F.col(f"{end}_{attribute}") if f"{end}_{attribute}" in columns else F.lit(None).cast("string") for end in ("src", "dst"))
    return F.when(one.isNull() | two.isNull() | (one == two), F.coalesce(one, two))


def seed_pairs(seeds: DataFrame, config: IncidentConfig) -> DataFrame:
    """Pairs of seeds (a, b) of a window that lie at most max_gap apart; more than the budget are an error.

    Of each attribute of group_by two known values must be equal.
    """
    groups = {f"__g{i}": metadata(seeds.columns, g) for i, g in enumerate(config.group_by)}
    rows = seeds.select("event_id", "w", "src", "dst", "t", *(c.alias(n) for n, c in groups.items()))
    pairs = band_join(rows, rows, config.max_gap, keys=["w"])
    pairs = pairs.where("t < t_r or (t = t_r and event_id < event_id_r)")
    for g in groups:  # a conflict only if both are known
        pairs = pairs.where(F.col(g).isNull() | F.col(f"{g}_r").isNull() | (F.col(g) == F.col(f"{g}_r"))).drop(g, f"{g}_r")
    n = pairs.count()
    if n > config.max_seed_pairs:
        raise RuntimeError(f"{n} pairs of seeds exceed the budget of {config.max_seed_pairs}")
    return pairs


def shared_ends(pairs: DataFrame) -> DataFrame:
    """Pairs of which the seeds share a node."""
    return pairs.where(_shared())


def _shared() -> Column:
    return F.expr("src = src_r or src = dst_r or dst = src_r or dst = dst_r")


def ancestor_links(edges: DataFrame, pairs: DataFrame, config: IncidentConfig) -> DataFrame:
    """(a, b, cost, path): of pairs of seeds the cheapest two paths back in time, by ancestry operations, to a common ancestor.

    Paths begin at both ends of a seed and at its time, and reach back to max_gap before the earlier seed at most.
    An event that both paths use counts once. More search states for a seed than the budget are an error. Of equal
    costs the path of fewest events, then of least ids, counts.
    """
    back = edges.where(F.col("op").isin(*config.ancestry_ops)).select(F.col("src").alias("__p"), F.col("dst").alias("__c"), F.col("t").alias("__t"), F.col("event_id").alias("__e"), F.col("cost").cast("double").alias("__cost"))
    back = graph._kept(back)
    ends = pairs.select(F.col("event_id").alias("seed"), "src", "dst", "t").unionByName(pairs.select(F.col("event_id_r").alias("seed"), F.col("src_r").alias("src"), F.col("dst_r").alias("dst"), F.col("t_r").alias("t"))).distinct()
    none = F.array().cast("array<struct<e:bigint,c:double>>").alias("path")
    state = graph._kept(ends.select("seed", "t", F.explode(F.array("src", "dst")).alias("node"), F.col("t").alias("at"), F.lit(0.0).alias("cost"), none).distinct())
    found = state
    best = Window.partitionBy("seed", "node", "at").orderBy("cost", F.size("path"), F.col("path.e"))
    for _ in range(config.ancestry_hops):
        # No pair reaches back further than twice the gap from either of its seeds.
        step = state.join(back, F.col("node") == F.col("__c")).where((F.col("__t") <= F.col("at")) & (F.col("__t") >= F.col("t") - 2 * config.max_gap))
        step = step.select("seed", "t", F.col("__p").alias("node"), F.col("__t").alias("at"), (F.col("cost") + F.col("__cost")).alias("cost"), F.concat("path", F.array(F.struct(F.col("__e").alias("e"), F.col("__cost").alias("c")))).alias("path"))
        # What goes on from a node depends on the time alone.
        state = graph._kept(step.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn"))
        found = graph._kept(found.unionByName(state))
        most = found.groupBy("seed").count().agg(F.max("count")).first()[0] or 0
        if most > config.max_search_states:
            raise RuntimeError(f"{most} states of an ancestry search exceed the budget of {config.max_search_states}")
    one, two = (found.select(F.col("seed").alias(s), "node", F.col("at").alias(f"at_{s}"), F.col("cost").alias(f"c_{s}"), F.col("path").alias(f"p_{s}")) for s in ("a", "b"))
    named = pairs.select(F.col("event_id").alias("a"), F.col("event_id_r").alias("b"), (F.least("t", "t_r") - config.max_gap).alias("low"))

    def cheapest(df: DataFrame, side: str, *by: str) -> DataFrame:
        order = Window.partitionBy(*by, "node").orderBy(f"c_{side}", F.size(f"p_{side}"), F.col(f"p_{side}.e"))
        return df.where(F.col(f"at_{side}") >= F.col("low")).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", f"at_{side}", f"c_{side}")

    left = cheapest(named.join(one, "a"), "a", "a", "b")
    right = cheapest(named.join(two, "b"), "b", "a", "b").drop("low")
    both = left.join(right, ["a", "b", "node"]).select("a", "b", F.array_distinct(F.concat("p_a", "p_b")).alias("path"))
    both = both.select("a", "b", F.aggregate("path", F.lit(0.0), lambda x, e: x + e["c"]).alias("cost"), F.transform("path", lambda e: e["e"]).alias("path"))
    top = Window.partitionBy("a", "b").orderBy("cost", F.size("path"), "path")
    return both.withColumn("rn", F.row_number().over(top)).where("rn = 1").drop("rn")


def neighbours(seeds: DataFrame, config: IncidentConfig) -> DataFrame:
    """(a, b) of seeds that share a node in a window, each with the next at most max_gap later: all that lie as close are joined by these."""
    ends = seeds.select("event_id", "w", "t", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    next_ = Window.partitionBy("w", "node").orderBy("t", "event_id")
    then = ends.select(F.col("event_id").alias("a"), F.lead("event_id").over(next_).alias("b"), (F.lead("t").over(next_) - F.col("t")).alias("gap"))
    return then.where(F.col("gap") <= config.max_gap).select("a", "b").distinct()


def seed_paths(edges: DataFrame, seeds: DataFrame, config: IncidentConfig) -> DataFrame:
    """(a, b, cost, path): the cheapest path in time between seeds of a window that lie at most max_gap apart and share no node.

    Each seed is searched from once; what it finds is joined with the seeds that begin there, so that no row is made
    for a pair without a path. Of seeds at the same time each may come first.
    """
    groups = {f"__g{i}": metadata(seeds.columns, g) for i, g in enumerate(config.group_by)}
    rows = graph._kept(seeds.select("event_id", "w", "src", "dst", "t", *(c.alias(n) for n, c in groups.items())))
    latest = rows.groupBy("w").agg(F.max("t").alias("__latest"))
    sources = rows.join(latest, "w").groupBy(F.col("dst").alias("start"), F.col("t").alias("lo")).agg(F.max(F.least(F.col("t") + config.max_gap, "__latest")).alias("hi"))
    found, _ = graph.searched(graph.path_links(edges), sources, config.max_hops, config.max_search_states, rows.select(F.col("src").alias("node")))
    first = rows.withColumns({"start": F.col("dst"), "lo": F.col("t")})
    second = rows.withColumnsRenamed({c: f"{c}_r" for c in rows.columns})
    both = found.select("start", "lo", "node", "at", "cost", "path").join(first, ["start", "lo"]).join(second, (F.col("node") == F.col("src_r")) & (F.col("w") == F.col("w_r")))
    both = both.where((F.col("at") <= F.col("t_r")) & (F.col("t_r") - F.col("t") <= config.max_gap) & (F.col("event_id") != F.col("event_id_r")) & ~_shared())
    for g in groups:  # a conflict only if both are known
        both = both.where(F.col(g).isNull() | F.col(f"{g}_r").isNull() | (F.col(g) == F.col(f"{g}_r")))
    ordered = (F.col("t") < F.col("t_r")) | (F.col("event_id") < F.col("event_id_r"))
    named = both.select(F.when(ordered, F.col("event_id")).otherwise(F.col("event_id_r")).alias("a"), F.when(ordered, F.col("event_id_r")).otherwise(F.col("event_id")).alias("b"), "cost", "path")
    return _cheapest(named)


def _cheapest(links: DataFrame) -> DataFrame:
    """Of each (a, b) the cheapest, of equal ones that of fewest events, then of least ids."""
    return links.groupBy("a", "b").agg(F.min(F.struct("cost", F.size("path").alias("n"), "path")).alias("m")).select("a", "b", "m.cost", "m.path")


def affinity(edges: DataFrame, seeds: DataFrame, config: IncidentConfig) -> DataFrame:
    """(a, b, cost, path) of pairs of seeds that belong together: by a shared node, a path in time, or a common ancestor; the cheapest counts.

    edges need `cost`. Path lists the connecting events. Of seeds that share a node only neighbours in time are linked,
    at no cost, which joins them all; only groups, which such links could cross, and ancestry, which is asked of each
    pair, need all pairs, and these are bounded by max_seed_pairs.
    """
    none = (F.lit(0.0).alias("cost"), F.array().cast("array<long>").alias("path"))
    pairs = graph._kept(seed_pairs(seeds, config)) if config.group_by or config.ancestry_ops else None
    direct = shared_ends(pairs).select(F.col("event_id").alias("a"), F.col("event_id_r").alias("b")) if config.group_by else neighbours(seeds, config)
    every = direct.select("a", "b", *none).unionByName(seed_paths(edges, seeds, config))
    if config.ancestry_ops:
        every = every.unionByName(ancestor_links(edges, graph._kept(pairs.where(~_shared())), config))
    return _cheapest(every)


def context(edges: DataFrame, core: DataFrame, seeds: DataFrame, config: IncidentConfig) -> DataFrame:
    """(incident, event_id): events next to the nodes of an incident, hop by hop, the earliest first, up to a cap per incident."""
    ends = core.join(edges.select("event_id", "src", "dst"), "event_id").select("incident", F.explode(F.array("src", "dst")).alias("node")).distinct()
    free = edges.join(seeds.select("event_id"), "event_id", "left_anti").select("event_id", "w", "src", "dst", "t")
    span = core.join(edges.select("event_id", "w"), "event_id").select("incident", "w").distinct()
    taken = None
    for _ in range(config.context_hops):
        near = ends.join(span, "incident").join(free.select("event_id", "w", "t", "src", "dst", F.explode(F.array("src", "dst")).alias("node")), ["w", "node"]).select("incident", "event_id", "t", "src", "dst").distinct()
        near = near.join(core.select("incident", "event_id"), ["incident", "event_id"], "left_anti")
        rank = Window.partitionBy("incident").orderBy("t", "src", "dst", "event_id")
        taken = graph._kept(near.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= config.max_context_edges).drop("rn"))
        ends = ends.unionByName(taken.select("incident", F.explode(F.array("src", "dst")).alias("node"))).distinct()
    return taken.select("incident", "event_id") if taken is not None else core.select("incident", "event_id").limit(0)


def build_incidents(edges: DataFrame, threshold: float, config: IncidentConfig = IncidentConfig()) -> DataFrame:
    """(incident, event_id, role): every seed once, connectors of the cheapest trees, then context.

    edges: (event_id, w, src, dst, t, op, loss). Incidents never leave a window; an incident is named by its
    least seed. A connector that is another incident's seed is an error; an event has the first of the roles
    seed, connector and context.
    """
    from auditloom.operators.scoring import checked_losses, seeds as select

    edges = graph._kept(checked_losses(edges))
    seeds = select(edges, threshold)
    if seeds.isEmpty():
        return edges.select(F.col("event_id").alias("incident"), "event_id", F.lit("seed").alias("role")).limit(0)
    penalty = F.lit(None).cast("double")
    for op, value in config.penalties.items():
        penalty = F.when(F.col("op") == op, value).otherwise(penalty)
    cost = edge_cost(F.col("loss"), F.lit(threshold or 1.0), F.col("near").cast("double"), F.lit(float(config.max_gap)), penalty, config.alpha, config.beta, config.gamma)
    costed = graph._kept(nearest_seed(edges, seeds).withColumn("cost", cost).drop("near"))
    links = graph._kept(affinity(costed, seeds, config))
    found = graph.components(links)
    named = seeds.select(F.col("event_id").alias("node")).join(found, "node", "left").select(F.coalesce("component", "node").alias("incident"), F.col("node").alias("event_id"))
    weighed = links.join(found, links["a"] == found["node"]).select("component", "a", "b", F.when(F.size("path") == 0, -1.0).otherwise(F.col("cost")).alias("weight"))  # what shares a node comes first
    trees = graph.spanning_trees(weighed).select(F.col("component").alias("incident"), "a", "b")
    connectors = trees.join(links, ["a", "b"]).select("incident", F.explode("path").alias("event_id")).distinct()
    crossing = connectors.join(named.withColumnRenamed("incident", "other"), "event_id").where("incident <> other")
    if not crossing.isEmpty():
        raise ValueError("a connector is the seed of another incident")
    connectors = connectors.join(named, ["incident", "event_id"], "left_anti")
    core = graph._kept(named.withColumn("role", F.lit("seed")).unionByName(connectors.withColumn("role", F.lit("connector"))))
    around = context(edges, core, seeds, config) if config.context_hops else core.limit(0)
    return core.unionByName(around.select("incident", "event_id").withColumn("role", F.lit("context")))


def summary(incidents: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each incident its span in time and its events by role."""
    n = lambda role: F.count(F.when(F.col("role") == role, 1)).alias(f"{role}s")
    return incidents.join(edges.select("event_id", "t"), "event_id").groupBy("incident").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"), n("seed"), n("connector"), n("context"))


def checked_roles(roles: DataFrame, events: DataFrame) -> DataFrame:
    """Roles (incident, role, src, dst, key, t, op, score) that fit the events (src, dst, key, t, op, score).

    An error for a role whose event is missing, has another time, operation or score (to a relative 1e-9 or an
    absolute 1e-12; a null score of a role isn't compared), and for an event with several roles in one incident.
    """
    if not roles.groupBy("incident", "src", "dst", "key").count().where("count > 1").isEmpty():
        raise ValueError("an event has more than one role in an incident")
    original = events.select("src", "dst", "key", F.col("t").alias("__t"), F.col("op").alias("__op"), F.col("score").alias("__score"), F.lit(True).alias("__there"))
    j = roles.join(original, ["src", "dst", "key"], "left")
    near = F.abs(F.col("score") - F.col("__score")) <= F.greatest(1e-9 * F.greatest(F.abs("score"), F.abs("__score")), F.lit(1e-12))
    wrong = F.when(F.col("__there").isNull(), "missing event").when(~(F.col("t") == F.col("__t")) | ~(F.col("op") == F.col("__op")), "event attributes").when(F.col("score").isNotNull() & ~F.coalesce(near, F.lit(False)), "anomaly score")
    found = j.select(wrong.alias("wrong")).where("wrong is not null").first()
    if found:
        raise ValueError(f"incidents and events don't match: {found['wrong']}")
    return j.select(*roles.columns)


def complete_epoch(scores: DataFrame, events: DataFrame) -> DataFrame:
    """The greatest epoch whose scores (epoch, event_id) cover each event once and nothing else."""
    total = events.agg(F.count("*").alias("total"))
    known = events.select("event_id", F.lit(1).alias("known"))
    per = scores.join(known, "event_id", "left").groupBy("epoch").agg(F.count("known").alias("n"), F.countDistinct("event_id").alias("d"), F.count("*").alias("rows"))
    return per.crossJoin(total).where("n = total and d = total and rows = total").agg(F.max("epoch").alias("epoch"))

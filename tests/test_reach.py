"""Questions of reach that make no rows for pairs, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import graph as G, incidents as I, strong, triage as T


def graphs():
    """Links on few nodes: parts of many sizes, chains, loops, twins at both ends and nodes apart."""
    for seed in range(6):
        rng = random.Random(seed)
        links = [(rng.randrange(30), rng.randrange(30)) for _ in range((20, 28, 36, 60, 90, 15)[seed])]
        yield links + [(100 + i, 3) for i in range(4)] + [(4, 200 + i) for i in range(4)] + [(50, 50), (60, 61)]


def reach(links, node, forward=True):
    near = {}
    for a, b in links:
        near.setdefault(a if forward else b, set()).add(b if forward else a)
    seen, front = {node}, [node]
    while front:
        front = [x for n in front for x in near.get(n, ()) if x not in seen and not seen.add(x)]
    return seen


def frame(spark, links):
    return spark.createDataFrame(links, "src long, dst long").repartition(3)


@pytest.mark.parametrize("most", [0, 10_000])
def test_parts(spark, most):
    for links in list(graphs())[1 :: 2 if most else 4]:
        nodes = {n for link in links for n in link}
        far = {n: reach(links, n) for n in nodes}
        got = {r.node: r.part for r in strong.parts(frame(spark, links), most).collect()}
        assert got == {n: min(m for m in far[n] if n in far[m]) for n in nodes}


def test_reach_counts(spark):
    for links in list(graphs())[::2]:
        nodes = sorted({n for link in links for n in link} | {999})
        asked = spark.createDataFrame([(n,) for n in nodes], "node long")
        for forward in (True, False):
            got = {r.root: r.n for r in G.reach_counts(frame(spark, links), asked, forward).collect()}
            assert got == {n: len(reach(links, n, forward)) for n in nodes}


def test_pseudo_roots_are_counted_first(spark):
    for links in list(graphs())[:3]:
        e, nodes = frame(spark, links), {n for link in links for n in link}
        roots = spark.createDataFrame([(n,) for n in nodes], "node long")
        want = {(n, m) for n in nodes for m in reach(links, n) - {n} if len(reach(links, n)) - 1 <= 0.3 * len(nodes)}
        assert {tuple(r) for r in G.pseudo_roots(e, roots, 0.3).collect()} == want
        assert {tuple(r) for r in G.pseudo_root_sizes(e, roots, 0.3).collect()} == {(n, sum(1 for a, _ in want if a == n)) for n, _ in want}


def test_classes_keep_pairs_few(spark):
    """A thousand ways in and out of one part make three classes and two links, not a million pairs."""
    links = [(1000 + i, 1) for i in range(1000)] + [(1, 2), (2, 1)] + [(2, 5000 + i) for i in range(1000)]
    of, between = strong.quotient(frame(spark, links))
    assert of.select("q").distinct().count() == 3 and between.count() == 2


def test_reachable_in_time_from_any(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.randrange(12), rng.randrange(20)) for _ in range(30)]
    e = spark.createDataFrame(rows, "src long, dst long, t long")
    start = spark.createDataFrame([(0, 3), (1, 5), (2, 0)], "node long, t long")
    each = G.temporal_reach(e, start, 50).groupBy("node").agg(F.min("t").alias("t"))
    got = [tuple(r) for r in G.temporal_reachable(e, start, 50).collect()]
    assert sorted(got) == sorted(tuple(r) for r in each.collect()) and len({n for n, _ in got}) == len(got)


def traced_by_hand(links, points, weight, method):
    nodes = {n for link in links for n in link}
    found = {(p, p) for p in points}
    for forward in (False, True):
        here, there = (0, 1) if forward else (1, 0)
        tips = {x[there] for x in links} - {x[here] for x in links}
        for p in points:
            far = reach(links, p, forward)
            if p not in nodes or not far & tips:
                continue
            way = {t: far & reach(links, t, not forward) for t in far & tips}
            end = min(way, key=lambda t: (-sum(weight.get(x, 0) for x in way[t]) / len(way[t]), t))
            if method == "component":
                found |= {(p, x) for x in way[end]}
                continue
            paths = [(p,)]
            while not any(x[-1] == end for x in paths):
                paths = [(*x, y[there]) for x in paths for y in set(links) if y[here] == x[-1] and y[there] not in x]
            found |= {(p, x) for x in min(x for x in paths if x[-1] == end)}
    return found


@pytest.mark.parametrize("method", ["component", "shortest_path"])
def test_trace_against_brute_force(spark, method):
    for seed, links in enumerate(list(graphs())[::3]):
        rng = random.Random(seed)
        nodes = sorted({n for link in links for n in link})
        weight = {n: float(rng.choice([0, 1, 2, 4, 8])) for n in nodes if n % 5}
        points = sorted(rng.sample(nodes, 12)) + [999]
        scores = spark.createDataFrame(list(weight.items()), "node long, score double")
        p = spark.createDataFrame([(n,) for n in points], "node long")
        got = [tuple(r) for r in T.trace(frame(spark, links), p, scores, method, "recon_loss").collect()]
        assert len(got) == len(set(got)) and set(got) == traced_by_hand(links, points, weight, method)


def test_points_share_the_way_to_an_end(spark, monkeypatch):
    """300 points before a mesh of 300 nodes: the search keeps a row for each node, not for each point and node."""
    links = [(i, 1000 + j) for i in range(300) for j in range(0, 30, 3)] + [(1000 + i, 1000 + (i * 7 + k) % 300) for i in range(300) for k in range(3)] + [(1299, 2000)]
    most, keep = [0], G._kept
    monkeypatch.setattr(T.graph, "_kept", lambda df: (most.append((kept := keep(df)).count()), kept)[1])
    ends = spark.createDataFrame([(i, 2000) for i in range(300)], "poi long, end long")
    assert T.shortest(frame(spark, links), ends, True).where("node = 1299").count() == 300 and max(most) <= 300 * 10 + 900 + 1


def test_budget_is_that_of_a_search(spark):
    """As in the reference: 20 searches of 5 states keep to a budget of 10, one of 30 doesn't."""
    rows = [(p * 10 + i, p * 10 + i, p * 10 + i + 1, i, 1.0) for p in range(20) for i in range(4)]
    e = spark.createDataFrame(rows, "event_id long, src long, dst long, t long, cost double")
    pairs = spark.createDataFrame([(p, p * 10, p * 10 + 4, 0, 9) for p in range(20)], "pair long, start long, target long, lo long, hi long")
    got = {r.pair: (r.cost, r.path) for r in G.temporal_paths(e, pairs, 5, budget=10).collect()}
    assert got == {p: (4.0, [p * 10 + i for i in range(4)]) for p in range(20)}
    turns = G.temporal_paths(e, pairs, 5, budget=10, slice_=7).collect()  # each start has an edge: three turns
    assert {r.pair: (r.cost, r.path) for r in turns} == got and len(turns) == 20
    star = spark.createDataFrame([(i, 0, i, i, 1.0) for i in range(1, 31)], e.schema)
    with pytest.raises(RuntimeError, match="budget"):
        G.temporal_paths(star, spark.createDataFrame([(0, 0, 7, 0, 99)], pairs.schema), 2, budget=10).collect()


def test_seeds_are_searched_from_once(spark):
    """The links of seeds are those of a search for each pair, and seeds that share nodes are joined by neighbours alone."""
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(i, rng.randrange(2), rng.randrange(14), rng.randrange(14), rng.randrange(40), float(rng.randrange(1, 5))) for i in range(90)]
        e = spark.createDataFrame(rows, "event_id long, w long, src long, dst long, t long, cost double")
        marked = [r for r in rows if r[0] % 5 == 0]
        config = I.IncidentConfig(max_gap=9, max_hops=2, max_seed_pairs=1)
        asked, shared = [], set()
        for a in marked:
            for b in marked:
                if a[1] == b[1] and a[0] != b[0] and 0 <= b[4] - a[4] <= 9:
                    one, two = sorted((a, b), key=lambda r: (r[4], r[0]))
                    if {a[2], a[3]} & {b[2], b[3]}:
                        shared.add((one[0], two[0]))
                    else:
                        asked.append((one[0] * 1000 + two[0], a[0], a[3], b[2], a[4], b[4]))
        p = spark.createDataFrame([((x[0], x[1]), *x[2:]) for x in asked], "pair struct<name:long, way:long>, start long, target long, lo long, hi long")
        want = {}
        for r in G.temporal_paths(e, p, 2).collect():
            key, value = divmod(r.pair.name, 1000), (r.cost, len(r.path), r.path)
            want[key] = min(want.get(key, value), value)
        seeds = e.where("event_id % 5 = 0")
        got = {(r.a, r.b): (r.cost, len(r.path), r.path) for r in I.seed_paths(e, seeds, config).collect()}
        assert got == want and want
        near = {tuple(r) for r in I.neighbours(seeds, config).collect()}
        assert near <= shared
        far = lambda links: {n: reach([*links, *((b, a) for a, b in links)], n) for n, *_ in marked}
        assert far(list(near)) == far(list(shared))


def test_incidents_of_more_pairs_than_the_budget(spark):
    """Pairs that are never made need no budget: 40 seeds of one node, and one that a path leads to."""
    rows = [(i, 0, 1, 100 + i, i, "a", 10.0) for i in range(40)] + [(50, 0, 139, 300, 41, "a", 0.1), (51, 0, 300, 301, 42, "a", 10.0), (60, 0, 900, 901, 42, "a", 10.0)]
    e = spark.createDataFrame(rows, "event_id long, w long, src long, dst long, t long, op string, loss double")
    got = {tuple(r) for r in I.build_incidents(e, 5.0, I.IncidentConfig(max_gap=60, max_hops=2, max_seed_pairs=1, context_hops=0)).collect()}
    assert got == {(0, i, "seed") for i in (*range(40), 51)} | {(0, 50, "connector"), (60, 60, "seed")}

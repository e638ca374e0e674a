"""Golden cases and brute force for operators that SQL can't hold."""

from __future__ import annotations

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.functions import scalars as S
from auditloom.operators import attacks, benchmarks, evaluation, features, graph as G, incidents as I, joins as J, memory as R, metrics as M, ranks, scoring as A, triage as T, unions, windows as W
from auditloom.sources import cdm, host_logs, reports, tables
from auditloom.streaming import windows as stream

EDGE = "event_id long, src long, dst long, t long, op string, loss double, w long"


def edges(spark, rows):
    return spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], EDGE)


def built(spark, rows, at, **settings):
    got = I.build_incidents(edges(spark, rows), at, I.IncidentConfig(**settings)).collect()
    return {(r.role, r.event_id) for r in got}, {r.incident for r in got}


def test_bridge(spark):
    rows = [(1, 2, 1, "a", 10.0), (2, 3, 2, "b", 0.1), (3, 4, 3, "b", 0.2), (4, 5, 4, "a", 11.0)]
    got, incidents = built(spark, rows, 5.0, max_gap=10, context_hops=0)
    assert incidents == {0}
    assert got == {("seed", 0), ("seed", 3), ("connector", 1), ("connector", 2)}


def test_common_ancestor(spark):
    rows = [(1, 2, 5, "x", 10.0), (3, 4, 5, "x", 10.0), (9, 1, 2, "fork", 0.0), (9, 1, 4, "fork", 0.0), (8, 9, 3, "fork", 0.0), (8, 3, 4, "fork", 0.0)]
    got, incidents = built(spark, rows, 5.0, max_gap=10, context_hops=0, ancestry_ops=("fork",), ancestry_hops=2)
    assert len(incidents) == 1
    assert got == {("seed", 0), ("seed", 1), ("connector", 3), ("connector", 4), ("connector", 5)}


def test_two_stories_and_an_isolated_seed(spark):
    chain = lambda n, t: [(n + i, n + i + 1, t + i, "a", 10.0 if i in (0, 4) else 0.1) for i in range(5)]
    rows = chain(0, 0) + chain(10, 0) + [(0, 1, 0, "b", 11.0), (100, 101, 0, "a", 12.0)]
    got, incidents = built(spark, rows, 5.0, max_gap=10, max_hops=4, context_hops=0)
    assert len(incidents) == 3
    assert sum(r == "seed" for r, _ in got) == 6 and sum(r == "connector" for r, _ in got) == 6


def test_no_seeds_and_bad_losses(spark):
    assert built(spark, [(1, 2, 1, "a", 1.0)], 5.0) == (set(), set())
    with pytest.raises(Exception, match="finite"):
        built(spark, [(1, 2, 1, "a", -1.0)], 5.0)


@pytest.mark.parametrize("value", [-1, 1.5, True, float("inf")])
def test_config_is_checked(value):
    with pytest.raises(ValueError):
        I.IncidentConfig(max_gap=value)


def cheapest(rows, start, target, hops):
    best = None
    stack = [(start, -1, 0.0, 0, ())]
    if start == target:
        return 0.0
    while stack:
        node, at, cost, n, used = stack.pop()
        if node == target and n:
            best = cost if best is None else min(best, cost)
            continue
        if n < hops:
            stack += [(d, t, cost + c, n + 1, (*used, i)) for i, (s, d, t, c) in enumerate(rows) if s == node and t >= at]
    return best


def test_temporal_paths_against_enumeration(spark):
    cases, links, pairs = {}, [], []
    for seed in range(12):
        rng = random.Random(seed)
        rows = [(rng.randrange(5), rng.randrange(5), rng.randrange(5), rng.random() * 2) for _ in range(12)]
        hops = 4
        for target in range(5):
            cases[seed * 10 + target] = cheapest(rows, 0, target, hops)
            pairs.append((seed * 10 + target, seed * 100, seed * 100 + target, 0, 10))
        links += [(seed * 100 + i, seed * 100 + s, seed * 100 + d, t, c) for i, (s, d, t, c) in enumerate(rows)]
    e = spark.createDataFrame(links, "event_id long, src long, dst long, t long, cost double")
    p = spark.createDataFrame(pairs, "pair long, start long, target long, lo long, hi long")
    got = {r.pair: r.cost for r in G.temporal_paths(e, p, 4).collect()}
    for pair, want in cases.items():
        assert (got.get(pair) is None) == (want is None)
        assert want is None or got[pair] == pytest.approx(want)


def by_kruskal(links):
    parent, tree = {}, set()

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted((w, a, b) for a, b, w in links):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            tree.add((a, b, w))
    return tree, {x: root(x) for e in links for x in e[:2]}


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_spanning_trees_and_components(spark, monkeypatch, most):
    """In one task, and in rounds; equal weights, several components, a loop."""
    monkeypatch.setattr(unions, "LINKS_A_TASK", most)
    rng = random.Random(1)
    links = list({(min(p), max(p)): (min(p), max(p), float(rng.randrange(6))) for p in ((rng.randrange(g, g + 40), rng.randrange(g, g + 40)) for g in (0, 100, 200) for _ in range(70)) if p[0] != p[1]}.values())
    df = spark.createDataFrame(links, "a long, b long, weight double").repartition(7)
    tree, roots = by_kruskal(links)
    comp = {r.node: r.component for r in G.components(df.select("a", "b").union(spark.createDataFrame([(999, 999)], "a long, b long"))).collect()}
    least = {}
    for x, r in roots.items():
        least[r] = min(least.get(r, x), x)
    assert comp == {x: least[r] for x, r in roots.items()} | {999: 999}
    named = df.join(spark.createDataFrame(list(comp.items()), "a long, component long"), "a")
    got = G.spanning_trees(named).collect()
    assert {(r.a, r.b, r.weight) for r in got} == tree and all(r.component == comp[r.a] for r in got)
    assert G.spanning_trees(named.limit(0)).count() == 0


def test_pruning(spark):
    rng = random.Random(5)
    links = {tuple(sorted((rng.randrange(30), rng.randrange(30)))) for _ in range(36)}
    links = {p for p in links if p[0] != p[1]}
    keep = {3, 7, 11}
    left = set(links)
    while True:
        degree = {n: sum(n in p for p in left) for p in left for n in p}
        gone = {n for n, k in degree.items() if k <= 1 and n not in keep}
        if not gone:
            break
        left = {p for p in left if not gone & set(p)}
    df = spark.createDataFrame(sorted(links), "a long, b long")
    assert {tuple(r) for r in G.pruned(df, spark.createDataFrame([(n,) for n in keep], "node long")).collect()} == left


def test_versions_order_by_time(spark):
    rows = [(1, 2, 1, "a", 0.0), (2, 3, 2, "a", 0.0), (1, 2, 3, "a", 0.0), (2, 3, 4, "a", 0.0)]
    got = {r.event_id: (r.src_version, r.dst_version) for r in W.versions(edges(spark, rows)).collect()}
    assert got == {0: (0, 1), 1: (1, 1), 2: (0, 2), 3: (2, 2)}


def test_hybrid_windows(spark):
    rows = [(1, 2, t, "a", 0.0) for t in (0, 1, 2, 30, 31, 32, 33, 34)]
    got = W.hybrid_windows(edges(spark, rows).withColumn("day", F.lit(0).cast("long")), 10, batch=2).orderBy("t").collect()
    assert [r.hw for r in got] == [0, 0, 0, 0, 1, 1, 1, 1]


def test_unique_pair_parts(spark):
    rows = [(1, 2, 0, "a", 0.0), (2, 3, 1, "a", 0.0), (1, 2, 2, "a", 0.0), (2, 3, 3, "a", 0.0), (2, 3, 4, "a", 0.0)]
    got = W.unique_pair_parts(edges(spark, rows), "w").orderBy("t").collect()
    assert [r.part for r in got] == [0, 0, 1, 1, 2]


def test_queues(spark):
    windows = spark.createDataFrame([(i,) for i in range(5)], "w long")
    overlap = spark.createDataFrame([(0, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 1)], "a long, b long, shared long")
    assert {(r.w, r.queue) for r in A.queues(windows, overlap).collect()} == {(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)}
    assert {(r.w, r.queue) for r in A.queues(windows, overlap, many=True).collect()} >= {(4, 0), (4, 1)}


def test_alignment_faults(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 6)], "src long, dst long, t long")
    good = e.withColumn("loss", F.lit(1.0))
    keys = ("src", "dst", "t")
    assert J.aligned(good, e, keys).count() == 2
    for bad in (good.union(good.limit(1)), good.union(spark.createDataFrame([(9, 9, 9, 1.0)], good.schema))):
        with pytest.raises(ValueError):
            J.aligned(bad, e, keys)


def test_band_join_is_exact(spark):
    rng = random.Random(2)
    times = [rng.randrange(200) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(times)), "event_id long, t long")
    got = {(r.event_id, r.event_id_r) for r in J.band_join(df, df, 7).collect()}
    assert got == {(i, k) for i, k in itertools.product(range(60), repeat=2) if abs(times[i] - times[k]) <= 7}


def test_seed_thresholds(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "loss double")
    assert A.threshold(df, "max_val_loss") == A.seed_threshold(df) == 4.0
    assert A.seed_threshold(df, "percentile") == pytest.approx(3.96)
    assert [A.seed_threshold(df, "percentile", x) for x in (0, 25, 50, 100)] == pytest.approx([1, 1.5, 2, 4])
    assert A.seeds(df, 2.0).count() == 2
    for bad in (df.limit(0), df.withColumnRenamed("loss", "x"), *(df.union(spark.createDataFrame([(v,)], "loss double")) for v in (None, -1.0, float("nan"), float("inf")))):
        with pytest.raises(ValueError):
            A.seed_threshold(bad)
    for method, percentile in (("mean", 99), ("percentile", -1), ("percentile", 100.5)):
        with pytest.raises(ValueError):
            A.seed_threshold(df, method, percentile)
    with pytest.raises(ValueError):
        A.threshold(df.limit(0), "max_val_loss")
    with pytest.raises(ValueError):
        A.reduced("magic")


def test_quantiles_by_ranks(spark):
    """Narrowed by counts as in one aggregate: ties, few and many distinct values, nulls."""
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 7.5], [1500, 3, 1]), np.zeros(50), rng.integers(0, 9, 700).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        for share in (0.0, 0.013, 0.5, 0.9, 1.0):
            assert ranks.quantile(df, "v", share, direct=20) == pytest.approx(float(np.quantile(values, share)))
    assert ranks.quantile(df.limit(0), "v", 0.5) is None


def test_ranks_across_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, x long").repartition(6)
    got = {r.id: r for r in ranks.numbered(df, [F.col("x").desc(), F.col("id")], "rn", ["g"]).collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]].rn for r in order] == list(range(len(order)))
    got = {r.id: r.x_0 for r in ranks.with_previous(df, "id", "x").collect()}
    assert got == {i: (rows[i - 1][2] if i else None) for i, *_ in rows}


def test_ancestry_from_both_ends(spark):
    """Paths begin at the target of a seed too, and reach back to the gap before the earlier seed only."""
    rows = [(1, 2, 100, "x", 10.0), (3, 4, 105, "x", 10.0), (9, 2, 99, "fork", 0.0), (9, 4, 98, "fork", 0.0)]
    config = {"max_gap": 10, "context_hops": 0, "ancestry_ops": ("fork",), "ancestry_hops": 2}
    got, incidents = built(spark, rows, 5.0, **config)
    assert len(incidents) == 1 and ("connector", 2) in got and ("connector", 3) in got
    far = [(a, b, t - 20 if op == "fork" else t, op, loss) for a, b, t, op, loss in rows]
    assert len(built(spark, far, 5.0, **config)[1]) == 2
    with pytest.raises(RuntimeError, match="budget"):
        built(spark, rows, 5.0, max_search_states=1, **config)


def test_groups_of_seeds(spark):
    """I4: an edge's own attribute, else that on which its nodes agree; a conflict parts seeds."""
    df = spark.createDataFrame([(0, 1, 2, 5, "a", 9.0, 0, "h1", "h1"), (1, 2, 3, 6, "a", 9.0, 0, "h1", "h2"), (2, 2, 4, 7, "a", 9.0, 0, "h2", None)], EDGE + ", src_host string, dst_host string")
    seen = {}
    for groups in ((), ("host",), ("host", "op")):
        pairs = I.seed_pairs(df, I.IncidentConfig(max_gap=10, group_by=groups)).collect()
        seen[groups] = {(r.event_id, r.event_id_r) for r in pairs}
    assert seen[()] == {(0, 1), (0, 2), (1, 2)} and seen[("host",)] == seen[("host", "op")] == {(0, 1), (1, 2)}


def test_checked_roles(spark):
    events = spark.createDataFrame([(1, 2, 0, 5, "a", 0.5), (2, 3, 0, 6, "b", 1.5)], "src long, dst long, key long, t long, op string, score double")
    roles = lambda *rows: spark.createDataFrame(rows, "incident long, role string, src long, dst long, key long, t long, op string, score double")
    good = ((1, "seed", 1, 2, 0, 5, "a", 0.5 + 1e-13), (1, "context", 2, 3, 0, 6, "b", None), (2, "seed", 2, 3, 0, 6, "b", 1.5))
    assert I.checked_roles(roles(*good), events).count() == 3
    for bad, what in (((1, "seed", 9, 2, 0, 5, "a", 0.5), "missing"), ((1, "seed", 1, 2, 0, 6, "a", 0.5), "attributes"), ((1, "seed", 1, 2, 0, 5, "b", 0.5), "attributes"), ((1, "seed", 1, 2, 0, 5, "a", 0.6), "score"), (good[1], "more than one role")):
        with pytest.raises(ValueError, match=what):
            I.checked_roles(roles(*good[1:2], bad), events)


def test_early_stop(spark):
    """By f1, auc or tnr; waits are counted from the last best value, or from one too low."""
    f1 = [(0, 0.5), (1, 0.6), (2, 0.58), (3, 0.3), (4, 0.59), (5, 0.6), (6, 0.55), (7, 0.9)]
    rows = [("p", e, 0.1, v, None, 0.9) for e, v in f1] + [("f", e, 0.01, 0.0, v, 0.9) for e, v in enumerate((0.7, 0.69, None, 0.5, 0.68, 0.68, 0.67))] + [("n", e, 0.0, 0.0, None, v) for e, v in enumerate((0.9, 0.9))]
    df = spark.createDataFrame(rows, "type string, epoch long, malicious double, f1 double, auc double, tnr double").repartition(3)
    got = {(r.type, r.epoch): (r.metric, r.best, r.waits, r.stopped) for r in M.early_stop(df).collect()}
    assert [got["p", e][2:] for e in range(8)] == [(0, False), (0, False), (1, False), (0, False), (1, False), (2, False), (3, True), (3, True)]
    assert got["p", 7][1] == 0.6
    assert [got["f", e][2] for e in (0, 1, 3, 4, 5, 6)] == [0, 1, 0, 1, 2, 3] and got["f", 6][3] and ("f", 2) not in got
    assert got["n", 1] == ("tnr", 0.9, 1, False)


def test_reports(spark, tmp_path):
    folder = str(tmp_path / "report")
    made = []

    def make(n):
        def run():
            made.append(n)
            return {"rows": spark.range(n)}

        return run

    assert reports.latest(spark, folder) is None
    assert reports.cached(spark, folder, "a", make(3))["rows"].count() == 3
    assert reports.cached(spark, folder, "a", make(4))["rows"].count() == 3 and made == [3]
    assert reports.cached(spark, folder, "b", make(5))["rows"].count() == 5 and made == [3, 5]
    with pytest.raises(ZeroDivisionError):
        reports.cached(spark, folder, "c", lambda: 1 / 0)
    assert reports.latest(spark, folder)["fingerprint"] == "b"


def test_epoch_selection(spark, tmp_path):
    scores, path = str(tmp_path / "scores"), str(tmp_path / "selected.json")
    spark.range(5).write.csv(scores)
    mark = reports.fingerprint(reports.inventory(spark, scores))
    reports.save_selection(spark, path, 7, "adp", {"adp": 0.5}, scores, mark)
    assert reports.load_selection(spark, path, "adp", scores)["epoch"] == 7
    with pytest.raises(ValueError, match="stale"):
        reports.load_selection(spark, path, "other", scores)
    for epoch, metrics in ((-1, {}), (True, {}), (3, {"adp": float("nan")})):
        with pytest.raises(ValueError):
            reports.save_selection(spark, path, epoch, "adp", metrics, scores, mark)
    spark.range(3).write.mode("append").csv(scores)
    with pytest.raises(ValueError, match="stale"):
        reports.load_selection(spark, path, "adp", scores)
    with pytest.raises(RuntimeError):
        reports.save_selection(spark, path, 7, "adp", {"adp": 0.5}, scores, mark)
    with pytest.raises(ValueError, match="no selection"):
        reports.load_selection(spark, path + "x", "adp", scores)


def test_source_ids(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.bin").write_bytes(b"\x00\xff")
    got = {r.name: r.source_id for r in reports.source_ids(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": hashlib.sha256(b"a.bin\x00\x00\xff").hexdigest()}


def test_batch_digests(spark):
    rows = [(i, i % 3, i % 4, 10 - i, 1, -i) for i in range(7)]
    df = spark.createDataFrame(rows, "event_id long, src long, dst long, t long, k long, v long")
    got = {r.batch: r.digest for r in W.batch_digest(W.batches(df, 4), ("src", "dst", "t", "k", "v")).collect()}
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    want = {b: hashlib.sha256(b"".join(int(x).to_bytes(8, "little", signed=True) for r in order[b * 4 : b * 4 + 4] for x in r[1:])).hexdigest() for b in (0, 1)}
    assert got == want


def test_hashed_characters(spark):
    assert [features.murmur3(x) & 0xFFFFFFFF for x in (b"", b"a", b"abc", b"test", b"Hello, world!")] == [0, 0x3C2569B2, 0xB3DD93FA, 0xBA6BD213, 0xC0363E43]
    df = spark.createDataFrame([(1, "file", " /a/b "), (2, "netflow", "1.2"), (3, "file", ""), (4, "file", None)], "node long, type string, label string")
    got = {r.node: np.array(r.vector) for r in features.hierarchical_hashes(df, 8).collect()}
    for node, text in ((1, "" + "/a" + "/a/b"), (2, "1" + "1.2"), (3, ""), (4, "")):
        want = np.zeros(8)
        for c in text:
            h = features.murmur3(c.encode())
            want[abs(h) % 8] += 1 if h >= 0 else -1
        assert got[node] == pytest.approx(want / (np.linalg.norm(want) + 1e-12))


def test_novelty(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) * 0.1 + 5])
    new = np.concatenate([x[:3], rng.normal(size=(5, 3)), [[9.0, 9, 9], [5, 5, 5.05]]])
    frame = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in features.novelty(frame(x), frame(new), k=10).collect()}

    def nearest(v, skip=None):
        d = np.linalg.norm(x - v, axis=1)
        if skip is not None:
            d[skip] = np.inf
        order = np.argsort(d, kind="stable")[:10]
        return d[order], order

    fit = [nearest(v, i) for i, v in enumerate(x)]
    density = lambda d, o: 1 / (np.mean([max(a, fit[j][0][-1]) for a, j in zip(d, o)]) + 1e-10)
    own = [density(*f) for f in fit]
    for i, v in enumerate(new):
        d, o = nearest(v)
        assert got[i] == pytest.approx(1.5 - np.mean([own[j] for j in o]) / density(d, o))
    assert got[8] < 0 < got[9]


def test_word_vectors(spark):
    """Tokens of equal company lie closer than those of another."""
    rng = random.Random(2)
    docs = [[rng.choice("abc") if i % 2 else rng.choice("xyz") for _ in range(12)] for i in range(300)]
    docs = [(["p", *d[:6], "q"] if i % 2 else ["r", *d[:6], "s"],) for i, d in enumerate(docs)]
    got = {r.token: np.array(r.vector) for r in features.word_vectors(spark.createDataFrame(docs + [([],), (["once"],)], "tokens array<string>"), 12, least=2, rounds=8).collect()}
    assert set(got) == set("abcxyzpqrs")
    cos = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    assert np.mean([cos("a", "b"), cos("x", "y"), cos("b", "c")]) > np.mean([cos("a", "x"), cos("b", "y"), cos("c", "z")]) + 0.1


def test_mimicry(spark):
    # 1 begins the attack and writes 100, which 2 reads later; 3 read it before.
    rows = [(1, 100, 10), (100, 2, 20), (100, 3, 5), (2, 101, 30), (4, 102, 40)]
    e = spark.createDataFrame(rows, "src long, dst long, t long")
    people, things, bad = (spark.createDataFrame([(n,) for n in x], "node long") for x in ((1, 2, 3, 4), (100, 101, 102), (1, 100, 2)))
    got = attacks.mimicry(e, people, things, bad, 40).collect()
    assert len(got) >= 40 and {r.subject for r in got} == {1, 2} and {r.file for r in got} <= {100, 101, 102}
    for _, steps in itertools.groupby(sorted(got, key=lambda r: (r.action, r.step)), key=lambda r: r.action):
        steps = list(steps)
        assert tuple(r.op for r in steps) in attacks.PATTERNS
        base = [t for s, d, t in rows if steps[0].subject in (s, d)]
        assert any(0 <= steps[0].t - t <= attacks.MOST_BIAS for t in base)
        assert all(0 <= b.t - a.t <= attacks.MOST_BIAS for a, b in zip(steps, steps[1:]))
        assert all((r.src, r.dst) == ((r.file, r.subject) if r.op == "EVENT_READ" else (r.subject, r.file)) for r in steps)
        assert all(r.uuid == hashlib.sha256(f"{r.subject}{r.file}{r.t}".encode()).hexdigest() for r in steps)
    assert sorted(got) == sorted(attacks.mimicry(e, people, things, bad, 40).collect())
    assert attacks.mimicry(e, people, things, bad.limit(0), 40).count() == 0


def test_unauthorised_access(spark):
    s = 10**9
    rows = [("train", 0, 50, 1, "EVENT_RECVFROM", 0), ("train", 0, 1, 100, "EVENT_OPEN", 4 * s), ("train", 0, 2, 101, "EVENT_OPEN", 8 * s), ("train", 1, 1, 100, "EVENT_OPEN", 20 * s), ("train", 2, 1, 101, "X", 30 * s), ("val", 3, 50, 1, "EVENT_RECVFROM", 40 * s), ("val", 3, 2, 102, "EVENT_OPEN", 44 * s), ("val", 3, 51, 2, "EVENT_RECVFROM", 46 * s)]
    e = spark.createDataFrame(rows, "split string, w long, src long, dst long, op string, t long")
    n = spark.createDataFrame([(1, "subject"), (2, "subject"), *((f, "file") for f in (100, 101, 102, 103)), (50, "netflow"), (51, "netflow")], "node long, type string")
    got = attacks.unauthorised(e, n, 5, 2, 1).collect()
    # Only 1 is reached in both splits; it touches 100 and 101, so that 102 alone is left, in window 3.
    assert {(r.split, r.w, r.src, r.op) for r in got} == {("val", 3, 1, "EVENT_OPEN"), ("val", 3, 1, "EVENT_READ"), ("val", 3, 1, "EVENT_WRITE"), ("val", 3, 1, "EVENT_CONNECT")}
    assert {r.dst for r in got if r.op != "EVENT_CONNECT"} == {102} and {r.dst for r in got if r.op == "EVENT_CONNECT"} <= {50, 51}
    times = {r.op: r.t for r in got}
    assert times["EVENT_READ"] - times["EVENT_OPEN"] == 3 and 40 * s <= times["EVENT_OPEN"] <= 46 * s
    with pytest.raises(RuntimeError):
        attacks.unauthorised(e.where("split = 'train'"), n, 5, 2, 1)


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 0.9, 1, 1), (2, 0.8, 0, 1), (3, 0.8, 1, 1), (4, 0.1, 0, 0)], "node long, score double, y int, y_hat int")
    assert M.roc_auc(rows).first().auc == pytest.approx(0.875)
    assert M.average_precision(rows).first().ap == pytest.approx(0.5 + 0.5 * 2 / 3)
    got = M.classifier_evaluation(rows).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.precision, got.recall) == (2, 1, 0, 1, 0.66667, 1.0)
    one = rows.where("y = 0")
    assert M.roc_auc(one).first().auc is None


def test_coverage(spark):
    members = spark.createDataFrame([(1, "seed", 1), (1, "seed", 2), (1, "connector", 3), (2, "seed", 3), (2, "context", 7)], "incident long, role string, node long")
    truth = spark.createDataFrame([(1, 0), (3, 0), (6, 0)], "node long, attack long")
    got = M.coverage(members, truth).first()
    assert (got.coverage_seeds, got.coverage_core, got.fragmentation, got.mixed) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 2.0, 0)
    none = M.coverage(members, truth.limit(0)).first()
    assert none.coverage_seeds is None


def test_complete_epoch(spark):
    events = spark.createDataFrame([(1,), (2,)], "event_id long")
    scores = spark.createDataFrame([(2, 1), (2, 2), (10, 1), (10, 2), (11, 1)], "epoch long, event_id long")
    assert I.complete_epoch(scores, events).first().epoch == 10


def test_signature_blocks(spark):
    nodes = spark.createDataFrame([("e", 1, "process"), ("e", 2, "file"), ("e", 3, "process")], "entry_id string, node long, type string")
    events = spark.createDataFrame([("e", 0, 1, 2, 10, "1"), ("e", 1, 2, 3, 20, "2"), ("e", 2, 1, 3, 30, "2")], "entry_id string, event_id long, src long, dst long, t long, op string")
    got = R.signatures(events, nodes, ("process", "file"), ("1", "2")).first().signature
    assert len(got) + 5 == R.dimension(5, 2, 2) == 20
    root5 = 5**0.5
    assert got[:3] == pytest.approx([1 / root5, 0.5 / root5, 0]) and got[3:6] == pytest.approx([0.5 / root5, 1 / root5, 0])
    assert got[6:] == pytest.approx([0, 0.5, 0, 0, 0, 0, 0, 0, 0])


def test_signature_with_vectors(spark):
    nodes = spark.createDataFrame([("e", 1, "process"), ("e", 2, "file"), ("f", 3, "file")], "entry_id string, node long, type string")
    events = spark.createDataFrame([("e", 0, 1, 2, 10, "1"), ("f", 1, 3, 3, 10, "9")], "entry_id string, event_id long, src long, dst long, t long, op string")
    vectors = spark.createDataFrame([("e", 1, [3.0, 0.0]), ("e", 2, [3.0, 8.0]), ("f", 3, [0.0, 0.0])], "entry_id string, node long, vector array<double>")
    got = {r.entry_id: r.signature for r in R.signatures(events, nodes, ("process", "file"), ("1", "2"), vectors=vectors, semantic=2).collect()}
    assert got["e"][:2] == pytest.approx([0.3, 0.4]) and got["f"][:2] == [0, 0] and len(got["e"]) == R.dimension(2, 2, 2)
    assert got["f"][2:8] == pytest.approx([0, 0.5, 0, 0, 0, 0.5])  # the operation is unknown, and an event is no path
    with pytest.raises(Exception, match="another length"):
        R.signatures(events, nodes, ("process", "file"), ("1", "2"), vectors=vectors, semantic=3).collect()


ENTRY = "entry_id string, label string, source_id string, host_id string, techniques array<string>, events array<string>"


def test_memory_store(spark, tmp_path):
    path = str(tmp_path / "memory")
    one = spark.createDataFrame([("b", "malicious", "s", "h", ["T1"], ["e"]), ("a", "benign", "s", "h", [], ["e"])], ENTRY)
    R.add(path, one)
    assert [r.entry_id for r in R.entries(spark, path).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        R.add(path, one.limit(1))
    bad = spark.createDataFrame([("c", "benign", "s", "h", ["T1"], ["e"])], ENTRY)
    with pytest.raises(Exception, match="admissible"):
        R.checked(bad).collect()


def test_times_and_labels(spark):
    df = spark.createDataFrame([("2018-04-10 14:30:00", "2019-09-23T11:23:45.5-04:00", 1523385000000000123)], "a string, b string, c long")
    got = df.select(S.text_to_ns(F.col("a")).alias("a"), S.iso_to_ns(F.col("b")).alias("b"), S.ns_to_text(F.col("c")).alias("c")).first()
    assert got.a == 1523385000 * 10**9
    assert got.b == 1569252225 * 10**9 + 5 * 10**6  # the digits are milliseconds as they stand
    assert got.c == "2018-04-10 14:30:00.000000123"
    one = spark.createDataFrame([("a/b/c", "1.2:3", "", "12")], "p string, n string, e string, i string")
    got = one.select(S.prefixes(F.col("p")).alias("p"), S.netflow_tokens(F.col("n")).alias("n"), S.path_tokens(F.col("e")).alias("e"), S.strict_long(F.col("i")).alias("i"), S.equal_parts(F.lit(7), 3).alias("q")).first()
    assert got.p == ["a", "a/b", "a/b/c"] and got.n == ["1", ".", "2", ":", "3"] and got.e == [""] and got.i == 12 and got.q == [3, 2, 2]
    with pytest.raises(Exception, match="not an integer"):
        one.select(S.strict_long(F.col("p"))).collect()


def test_cdm_logs(spark, tmp_path):
    kind = lambda k, body: json.dumps({"datum": {f"com.bbn.tc.schema.avro.cdm18.{k}": body}}, separators=(",", ":"))
    ref = lambda u: {"com.bbn.tc.schema.avro.cdm18.UUID": u}
    lines = [
        kind("NetFlowObject", {"uuid": "N", "localAddress": "1.1.1.1", "localPort": {"int": 5}, "remoteAddress": {"string": "2.2.2.2"}}),
        kind("Subject", {"uuid": "S", "cmdLine": {"string": "ls"}, "properties": {"map": {"path": "/bin/ls"}}}),
        kind("Subject", {"uuid": "S", "cmdLine": "ls -l", "properties": {"map": {}}}),
        kind("FileObject", {"uuid": "F", "baseObject": {"properties": {"map": {"path": "/etc/x"}}}}),
        kind("Event", {"uuid": "E1", "type": "EVENT_READ", "subject": ref("S"), "predicateObject": ref("F"), "timestampNanos": 7, "z": 0}),
        kind("Event", {"uuid": "E2", "type": "EVENT_WRITE", "subject": ref("S"), "predicateObject": ref("N"), "timestampNanos": 8, "z": 0}),
        kind("Event", {"uuid": "E3", "type": "EVENT_OTHER", "subject": ref("S"), "predicateObject": ref("N"), "timestampNanos": 9, "z": 0}),
        kind("Event", {"uuid": "E4", "type": "EVENT_WRITE", "subject": ref("?"), "predicateObject": ref("N"), "timestampNanos": 9, "z": 0}),
    ]
    (tmp_path / "log.json").write_text("\n".join(lines))
    log = cdm.lines(spark, str(tmp_path))
    n, s, f = cdm.netflows(log).first(), cdm.subjects(log).first(), cdm.files(log).first()
    assert (n.src_addr, n.src_port, n.dst_addr, n.dst_port) == ("1.1.1.1", "5", "2.2.2.2", "null")
    assert (s.path, s.cmd, f.path) == ("null", "ls -l", "/etc/x")
    nodes, events = cdm.ingest(spark, str(tmp_path))
    assert {(r.uuid, r.index_id) for r in nodes.collect()} == {("N", 0), ("S", 1), ("F", 2)}
    assert {(r.event_uuid, r.src, r.dst, r.t) for r in events.collect()} == {("E1", 2, 1, 7), ("E2", 1, 0, 8)}


def test_host_logs(spark, tmp_path):
    row = lambda i, action, obj, target, **props: json.dumps({"id": i, "hostname": "h1.x.com", "action": action, "object": obj, "actorID": "A", "objectID": target, "timestamp": "2019-09-23T11:23:45.012-04:00", "properties": props})
    lines = [row("1", "READ", "FILE", "F", file_path="C:\\x", image_path="p"), row("2", "OPEN", "FLOW", "W", direction="inbound", src_ip="1"), row("3", "DELETE", "FILE", "F")]
    (tmp_path / "log.json").write_text("\n".join(lines))
    acts = host_logs.actions(spark, str(tmp_path), "h1", ("READ", "OPEN"))
    nodes = host_logs.host_nodes(acts)
    got = {(r.uuid, r.node_type, r.path, r.src_addr) for r in nodes.collect()}
    assert got == {("A", "subject", None, None), ("F", "file", "C:/x", None), ("W", "netflow", None, "1")}
    assert {(r.src, r.dst) for r in host_logs.host_events(acts, nodes).collect()} == {("F", "A"), ("W", "A")}


def test_label_files(spark, tmp_path):
    (tmp_path / "attacks").mkdir()
    (tmp_path / "attacks" / "one.csv").write_text("u1,\"{'file': 'x'}\",5\nu2,\"{'file': 'y'}\",6\nu2,\"{'file': 'y'}\",6\n")
    assert {(r.attack, r.node) for r in tables.read_attack_labels(spark, str(tmp_path / "attacks")).collect()} == {("one", 5), ("one", 6)}
    (tmp_path / "full.csv").write_text("node_id,is_malicious\n1,0\n2,1\n")
    assert tables.read_complete_labels(spark, str(tmp_path / "full.csv")).count() == 2
    (tmp_path / "twice.csv").write_text("node_id,is_malicious\n1,0\n1,1\n")
    with pytest.raises(ValueError):
        tables.read_complete_labels(spark, str(tmp_path / "twice.csv"))
    (tmp_path / "truth.txt").write_text("abc\n\ndef,\"{'subject': 'q'}\",9\n")
    assert {tuple(r) for r in tables.read_ground_truth(spark, str(tmp_path / "truth.txt")).collect()} == {("abc", "threatrace", None), ("def", "{'subject': 'q'}", 9)}
    (tmp_path / "scores.csv").write_text("loss,srcnode,dstnode,time,edge_type\n0.5,1,2,1700000000000000001,3\n")
    assert tables.read_scores(spark, str(tmp_path / "scores.csv")).first().time == 1700000000000000001


def test_tables_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([("test", 3, 1, 2, 10**18 + 1, 0.5), ("val", 3, 1, 3, 7, 0.25)], "split string, epoch long, srcnode long, dstnode long, time long, loss double")
    tables.write_scores(scores, str(tmp_path / "scores"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "scores")).select(scores.columns).collect()} == {tuple(r) for r in scores.collect()}
    assert (tmp_path / "scores" / "split=val" / "epoch=3").is_dir()
    e = spark.createDataFrame([(1, 5, 9), (2, 5, 3), (3, 6, 1)], "event_id long, w long, t long").repartition(3)
    tables.write_windows(e, str(tmp_path / "windows"))
    back = spark.read.parquet(str(tmp_path / "windows" / "w=5"))
    assert [r.event_id for r in back.collect()] == [2, 1]  # by time within a window


def test_stream_sessions_and_seeds(spark, tmp_path):
    rows = [(i, u, f"2024-01-01 {h:02d}:{m:02d}:00", float(m)) for i, (u, h, m) in enumerate([(1, 0, 0), (1, 0, 20), (1, 2, 0), (2, 0, 10)])]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events"))
    read = lambda: stream.read_events(spark, str(tmp_path / "events"))
    got = stream.run_once(stream.sessions(read(), "30 minutes"), "sessions").collect()
    assert sorted((r.user_id, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]
    assert {r.event_id for r in stream.run_once(stream.seeds(read(), 10.0), "seeds", "append").collect()} == {1, 3}


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "events"))
    live = stream.run_once(stream.window_scores(stream.read_events(spark, str(tmp_path / "events"))), "hours")
    batch = source.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.count("*").alias("n"), F.max("value").alias("max_loss"))
    assert {(r.window.start, r.n, r.max_loss) for r in live.collect()} == {(r.window.start, r.n, r.max_loss) for r in batch.collect()}
    once = stream.run_once(stream.distinct_events(stream.read_events(spark, str(tmp_path / "events")), "60 days"), "once", "append")
    assert once.count() == source.count()


def test_stream_state(spark, tmp_path):
    """Neighbours before each batch, as the batch operator has them."""
    rng = random.Random(8)
    rows = [(i, rng.randrange(4), 10 + rng.randrange(5), i) for i in range(60)]
    schema = "event_id long, src long, dst long, t long"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "edges"))
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "edges"))
    ends = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "t", "event_id").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "t", "event_id"))
    got = sorted((r.node, list(r.neighbours)) for r in stream.run_once(stream.last_neighbours(ends, 3), "neighbours", "append").collect())
    whole = spark.createDataFrame([(*r, r[0] // 20) for r in rows], schema + ", batch long")
    want = sorted((r.node, list(r.neighbours)) for r in W.last_neighbours(whole, 3).collect())
    assert got == want


def test_builder_under_the_clock(spark):
    edges, validation, truth = benchmarks.synthetic_region(spark, 20)
    assert edges.count() == 12 + 40
    at = A.seed_threshold(validation)
    report = benchmarks.benchmark(edges, at, {"near": I.IncidentConfig(max_gap=10 * benchmarks.SECOND, max_hops=4, context_hops=0), "apart": I.IncidentConfig(max_gap=1, context_hops=0)}, 2, truth)
    near, apart = report["near"]["metrics"], report["apart"]["metrics"]
    assert (near["incidents"], near["seeds"], near["connectors"], near["seed_retention"], near["coverage_core"]) == (2, 4, 6, 1.0, 1.0)
    assert (apart["incidents"], apart["connectors"]) == (4, 0) and report["near"]["events_per_second"] > 0
    with pytest.raises(ValueError):
        benchmarks.benchmark(edges, at, {}, 1)


def test_command_line(spark, tmp_path):
    from auditloom.__main__ import main

    edges, validation, _ = benchmarks.synthetic_region(spark, 3)
    edges.write.parquet(str(tmp_path / "events"))
    validation.write.parquet(str(tmp_path / "validation"))
    call = ["incidents", "--events", str(tmp_path / "events"), "--output", str(tmp_path / "out"), "--validation", str(tmp_path / "validation"), "--max-hops", "4", "--context-hops", "0"]
    main(call)
    assert spark.read.parquet(str(tmp_path / "out")).where("role = 'seed'").count() == 4
    with pytest.raises(Exception, match="exist"):
        main(call)
    with pytest.raises(SystemExit):
        main(call[:5])


def test_evaluation(spark, tmp_path):
    """Three epochs, the last of which lacks a window; attack nodes that aren't there; a report that is made once."""
    ns = 1658188800000000000
    rows = [(0, "val", 0, 100, 101, ns, "1", 1.0), (1, "val", 0, 101, 102, ns + 1, "1", 2.0), (2, "test", 1, 1, 2, ns + 10, "1", 4.0), (3, "test", 1, 2, 3, ns + 11, "1", 0.2), (4, "test", 1, 3, 4, ns + 12, "1", 4.0), (5, "test", 2, 1, 5, ns + 100, "1", 4.0), (6, "test", 2, 6, 7, ns + 101, "1", 0.1)]
    e = spark.createDataFrame(rows, "event_id long, split string, w long, src long, dst long, t long, op string, loss double")
    scores = e.select(F.explode(F.array(*map(F.lit, (2, 10, 11)))).alias("epoch"), "event_id", "loss", "w").where("epoch <> 11 or w <> 2").drop("w")
    truth = spark.createDataFrame([(n, 0) for n in (1, 3, 6, 999)], "node long, attack long")
    go = lambda **more: evaluation.evaluate(e.drop("loss"), scores, truth, str(tmp_path / "r"), I.IncidentConfig(max_gap=100, context_hops=0), **more)
    got = go()
    run, cover = got["run"].first(), got["coverage"].first()
    assert (run.epoch, run.threshold, run.events, run.present, run.absent) == (10, 2.0, 5, 3, 1)
    assert (cover.coverage_seeds, cover.coverage_core, cover.fragmentation) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 2.0)
    assert got["incidents"].select("incident").distinct().count() == 2
    first = reports.latest(spark, str(tmp_path / "r"))
    go()
    assert reports.latest(spark, str(tmp_path / "r")) == first
    assert go(epoch=2)["run"].first().epoch == 2 and reports.latest(spark, str(tmp_path / "r")) != first
    with pytest.raises(ValueError):
        go(epoch=11)


def test_adjacency_walks(spark):
    rows = [(1, 2, "a"), (1, 2, "b"), (1, 3, "a"), (2, 4, "c"), (4, 1, "d"), (3, 3, "e")]
    e = spark.createDataFrame(rows, "src long, dst long, op string")
    got = G.adjacency_walks(e, 3, 20).collect()
    count = {(r.way, r.start): 0 for r in got}
    for r in got:
        count[r.way, r.start] += 1
        parts = r.path.split(",")
        assert int(parts[0]) == r.start and len(parts) % 2 == 1
        steps = [(int(parts[k]), parts[k + 1], int(parts[k + 2])) for k in range(0, len(parts) - 2, 2)]
        assert all(((a, b, op) if r.way == "ahead" else (b, a, op)) in rows for a, op, b in steps) and len(steps) == 3
    assert count == {("ahead", 1): 40, ("ahead", 2): 20, ("ahead", 4): 20, ("ahead", 3): 20, ("back", 2): 20, ("back", 3): 40, ("back", 4): 20, ("back", 1): 20}
    ends = {r.path.split(",")[1] for r in got if (r.way, r.start) == ("ahead", 1)}
    assert ends == {"a", "b"}
    short = {r.path for r in G.adjacency_walks(e.where("op in ('a', 'c') and dst <> 3"), 3, 1).collect()}
    assert short == {"1,a,2,c,4", "2,c,4", "2,a,1", "4,c,2,a,1"}


def test_subgraphs_of_anomalies(spark):
    """Events between anomalous nodes around the best of each type; equal ones once; evenly thinned; by severity."""
    rows = [(i, s, d, o, float(w)) for i, (s, d, o, w) in enumerate([(1, 10, "r", 5), (10, 2, "w", 6), (2, 11, "r", 7), (3, 12, "w", 1), (9, 10, "r", 50), (12, 3, "x", 1)])]
    e = spark.createDataFrame(rows, "event_id long, src long, dst long, op string, loss double")
    bad = spark.createDataFrame([(1, "p", 9.0), (2, "p", 8.0), (3, "p", 7.0), (10, "f", 9.0), (11, "f", 1.0), (12, "f", 8.0)], "node long, type string, score double")
    sub = lambda **more: {(r.seed, r.event_id) for r in T.anomaly_subgraphs(e, bad, per_type=2, **more).collect()}
    assert sub() == {(1, 0), (2, 1), (2, 2), (10, 0), (10, 1), (12, 3), (12, 5)}
    assert sub(least=6.0) == {(2, 1), (2, 2), (10, 0), (10, 1)}
    assert len(sub(max_edges=1)) < 7


def test_campaign_by_hops(spark):
    rng = random.Random(4)
    links = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)}
    e = spark.createDataFrame([(a, b) for a, b in links], "src long, dst long")
    bad = {1, 2, 3}
    want, front = dict.fromkeys(bad, 0), set(bad)
    for hop in (1, 2, 3):
        front = {y for a, b in links for x, y in ((a, b), (b, a)) if x in front} - want.keys()
        want |= dict.fromkeys(front, hop)
    start = spark.createDataFrame([(n,) for n in bad], "node long")
    assert {r.node: r.hop for r in T.campaign(e, start).collect()} == want
    capped = {r.node: r.hop for r in T.campaign(e, start, (3, 2, 1)).collect()}
    assert sorted(capped.values()) == [0, 0, 0, 1, 1, 2] and capped.items() <= want.items() or len(capped) == 6


def test_slices_by_role(spark):
    rows = [(1, "context", 1), (1, "seed", 9), (1, "connector", 3), (1, "connector", 2), (2, "context", 4)]
    df = spark.createDataFrame(rows, "incident long, role string, event_id long")
    assert {tuple(r) for r in T.bounded_slice(df, 2).select("incident", "event_id").collect()} == {(1, 9), (1, 2), (2, 4)}

"""Registered queries that do the whole job, against brute force on the smallest tables."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from auditloom.operators import features, graph as G, memory as R, metrics as M, triage as T
from auditloom.plans import catalog, core, detection

DATA = "/root/testdata/sf0.001"


def relaxed_by_hand(rows, links, hops):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)

    def within(nodes):
        for _ in range(hops):
            nodes = nodes | {b for a in nodes for b in near[a]}
        return nodes

    truth, hits = within({n for n, y, _ in rows if y}), within({n for n, y, p in rows if y and p})
    tp = sum(1 for n, y, p in rows if y and (p or n in hits))
    return tp, sum(1 for n, y, p in rows if not y and p and n not in truth), sum(1 for n, y, p in rows if y and not p and n not in hits)


def test_relaxed_reaches_two_hops(spark):
    # 1 is a hit; 3 is a miss and 13 is false, both two hops from what excuses them; 4 and 14 are three away.
    links = [(1, 2), (2, 3), (21, 3), (21, 4), (11, 12), (12, 13), (13, 14)]
    rows = [(1, 1, 1), (3, 1, 0), (11, 1, 0), (13, 0, 1), (14, 0, 1)]
    p = spark.createDataFrame(rows, "node long, y int, y_hat int")
    got = M.relaxed(p, spark.createDataFrame(links, "src long, dst long")).first()
    assert (got.tp, got.fp, got.fn) == relaxed_by_hand(rows, links, 2) == (2, 1, 1)
    assert (got.tp, got.fp, got.fn) != relaxed_by_hand(rows, links, 1)


def test_relaxed_two_hops(spark):
    rows = [(r.node, r.y, r.y_hat) for r in detection.predictions(spark, DATA).collect()]
    links = [(r.src, r.dst) for r in core.edges(spark, DATA).where("split = 'test'").collect()]
    got = catalog.QUERIES["relaxed"](spark, DATA).first()
    tp, fp, fn = relaxed_by_hand(rows, links, 2)
    assert (got.tp, got.fp, got.fn) == (tp, fp, fn) != relaxed_by_hand(rows, links, 1)
    assert got.recall == pytest.approx(tp / (tp + fn), abs=1e-6)


def test_retrieve_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(240, 6)).round(1)
    v[200:] = v[rng.integers(0, 40, 40)]  # equal vectors: ties go to the least id
    v[7] = 0
    rows = [(i, int(i % 3), x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "entry_id long, label long, signature array<double>").repartition(5)
    asked = df.where("entry_id % 4 = 0 or entry_id = 7").selectExpr("entry_id as query", "signature")
    got = {tuple(r) for r in R.retrieve(asked, df, 2, 0.9, block=9).select("query", "entry_id", "label", "rank", "strong").collect()}
    norm = lambda x: x / np.sqrt((x * x).sum()) if x.any() else x
    want = set()
    for q in [i for i in range(240) if i % 4 == 0 or i == 7]:
        near = sorted((-round(float(norm(v[q]) @ norm(v[i])), 9), i) for i in range(240))
        strong = [x for x in near if x[0] <= -0.9]
        for label in range(3):
            want |= {(q, i, label, rank, True) for rank, (_, i) in enumerate([x for x in strong if x[1] % 3 == label][:2], 1)}
        if not strong:
            want.add((q, near[0][1], near[0][1] % 3, 1, False))
    assert got == want


def test_all_vectors_are_asked(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert len(ids) > 5
    for name in ("retrieval", "weak_retrieval"):
        assert {r["query"] for r in catalog.QUERIES[name](spark, DATA).collect()} == ids


def test_all_splits_take_part(spark):
    e = core.edges(spark, DATA).collect()
    assert {r.split for r in e} == {"train", "val", "test"}
    for name in ("asof_previous", "node_versions", "last_updates"):
        assert {r.event_id for r in catalog.QUERIES[name](spark, DATA).collect()} == {r.event_id for r in e}
    want, last = {}, {}
    ordered = sorted(e, key=lambda r: (r.t, r.event_id))
    for w in sorted({r.w for r in e}):
        now = [r for r in ordered if r.w == w]
        for node in {n for r in now for n in (r.src, r.dst)}:
            want[w, node] = ",".join(map(str, last.get(node, [])[-5:]))
        for r in now:
            last.setdefault(r.src, []).append(r.dst)
            last.setdefault(r.dst, []).append(r.src)
    assert {(r.w, r.node): r.neighbours for r in catalog.QUERIES["last_neighbours"](spark, DATA).collect()} == want


def test_negatives_of_all_splits(spark):
    e = core.edges(spark, DATA)
    got = {(r.src, r.dst) for r in catalog.QUERIES["negative_edges"](spark, DATA).collect()}
    part = lambda split: {(r.src, r.dst) for r in features.negatives(e.where(f"split = '{split}'")).collect()}
    known = {(r.src, r.dst) for r in e.collect()}
    assert got == (part("train") | part("val") | part("test")) - known
    assert not got <= part("val")


def test_knn_outliers_are_standardised(spark):
    rng = np.random.default_rng(2)
    v = np.column_stack([rng.normal(size=60) * 1000, rng.normal(size=60) * 0.01, np.full(60, 3.0)])
    v[5, 1] = 0.2  # far out in the narrow dimension only
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in features.knn_outliers(df, df, 4).collect()}
    dev = v.std(axis=0)
    z = (v - v.mean(axis=0)) / np.where(dev > 1e-12, dev, 1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    mean = np.sort(d, axis=1)[:, :4].mean(axis=1)
    assert [got[i] for i in range(60)] == pytest.approx((mean / mean.mean()).tolist())
    assert max(got, key=got.get) == 5


def test_shortest_paths_have_no_limit(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long").coalesce(1)
    ends = spark.createDataFrame([(0, 70)], "poi long, end long")
    assert {r.node for r in T.shortest(chain, ends, True).collect()} == set(range(71))
    with pytest.raises(RuntimeError):
        T.shortest(chain, ends, True, rounds=5)


def test_temporal_walks(spark):
    rows = [(0, 1, 2, 5), (1, 2, 3, 6), (2, 2, 4, 4), (3, 1, 9, 10**9)]
    e = spark.createDataFrame(rows, "event_id long, src long, dst long, t long")
    start = spark.createDataFrame([(w, 1) for w in range(40)] + [(100, 3), (101, 4)], "walk long, node long")
    got = {r.walk: r.nodes for r in G.temporal_walks(e, start, 4, 10).collect()}
    assert all(got[w] == [1, 2, 3] for w in range(40))  # the late edge has next to no weight
    assert got[100] == [1, 2, 3] and got[101] == [2, 4]  # backward, strictly falling times
    even = {tuple(r.nodes) for r in G.temporal_walks(e, start.where("walk < 40"), 4).collect()}
    assert even == {(1, 2, 3), (1, 9)}


def test_campaign_edges(spark):
    rows = [(5, 1, "a"), (1, 5, "b"), (9, 5, "c"), (9, 8, "d"), (8, 1, "e"), (20, 21, "f")]
    e = spark.createDataFrame(rows, "src long, dst long, op string")
    got = {tuple(r) for r in T.campaign_edges(e, spark.createDataFrame([(1,), (5,)], "node long")).collect()}
    assert got == {(1, 5, "a", 0), (5, 9, "c", 1), (1, 8, "e", 1)}

"""Connected components and minimum spanning forests: each task joins what it holds, and only forests go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.ranks import kept

#: Links that one task holds at once: as few are joined there without any rounds.
LINKS_A_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of links: each node but the roots with the least node that it reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low < high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])  # roots are hooked to lesser ones
        while (label[label] != label).any():
            label = label[label]
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), b < a, that join the same nodes as those of each partition, at most one for a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = (np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False)]) for old, c in ((a, "a"), (b, "b")))
            if len(a) > LINKS_A_TASK:
                a, b = forest(a, b)
        a, b = forest(a, b)
        for at in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _star(links: DataFrame) -> DataFrame:
    """(a, b, m): each link with m, the least of a and its neighbours; adaptive execution splits the rows of a hub."""
    least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return links.join(least, "a")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id of the links (a, b): the least id that links reach.

    Self-links and repeated links are harmless; ids without links to others don't appear. Tasks contract what they
    hold. Where that leaves more links than one task takes, rounds of large and small stars follow, each of which
    halves the longest paths at least; their tables are checkpointed.
    """
    edges = kept(contracted(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))))
    for _ in range(rounds):
        if edges.count() <= LINKS_A_TASK:
            edges = kept(contracted(edges.coalesce(1)))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = kept(_star(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _star(large)
        pairs = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        after = kept(contracted(pairs.distinct()))
        state = [tuple(x.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()) for x in (edges, after)]
        edges = after
        if state[0] == state[1]:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return kept(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots))


def _lightest(component: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The places of the minimum spanning forest, ties by (weight, a, b)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    keep = []
    for i in np.lexsort((b, a, weight)).tolist():
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            parent[x] = y
            keep.append(i)
    return np.array(keep, dtype=np.int64)


def spanning_forest(links: DataFrame) -> DataFrame:
    """(component, a, b, weight): of links those of the minimum spanning tree of each component, ties by (weight, a, b).

    A link that closes a cycle of lighter ones within any part of the links is in no tree of them all. So tasks drop
    such links of their parts, and fewer and fewer tasks go on with what is left.
    """
    columns = ["component", "a", "b", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows > 2 * LINKS_A_TASK:
                held = held.take(pa.array(_lightest(*(held.column(c).to_numpy() for c in columns))))
        if held is not None:
            yield from held.take(pa.array(_lightest(*(held.column(c).to_numpy() for c in columns)))).to_batches(max_chunksize=50_000)

    thin = lambda df: kept(df.mapInArrow(run, "component long, a long, b long, weight double"))
    left = thin(links.select("component", F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("double")))
    while (parts := left.select(F.spark_partition_id()).distinct().count()) > 1:
        left = thin(left.coalesce(1 if left.count() <= LINKS_A_TASK else -(-parts // 4)))
    return left

"""Connected components of links: contracted inside tasks first, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import arrow_map, durable, release

#: Links that one task holds at once: 16 bytes each. As few are joined there without any rounds.
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


def _contracted(edges: DataFrame) -> DataFrame:
    """Links (a, b), b < a, that join the same nodes as those of each partition, at most one for a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            a, b = (np.concatenate(pair) for pair in zip((a, b), more))
            if len(a) > LINKS_A_TASK:
                a, b = forest(a, b)
        a, b = forest(a, b)
        for at in range(0, len(a), 50_000):
            yield {"a": a[at : at + 50_000], "b": b[at : at + 50_000]}

    return arrow_map(edges, run, "a long, b long")


def _star(edges: DataFrame) -> DataFrame:
    """(a, b, m): each edge with m, the least of a and its neighbours; adaptive execution splits the rows of a hub."""
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return edges.join(least, "a")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id of the links (a, b): the least id that links reach.

    Self-links and repeated links are harmless; ids without links to others don't appear. Tasks contract what they
    hold. Where that leaves more links than one task takes, rounds of stars follow, each of which halves the longest
    paths at least; their tables are checkpointed.
    """
    edges = durable(_contracted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(rounds):
        n = edges.count()
        if n <= LINKS_A_TASK:
            edges = durable(_contracted(edges.coalesce(1)))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large)  # repeated links are harmless until the round's end
        small = _star(large)
        pairs = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        after = durable(_contracted(pairs.distinct()))
        state = tuple(after.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()):
            break
        edges = after
        release(links.sparkSession)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return durable(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots))

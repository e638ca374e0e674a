"""Strongly connected parts, and the small graph between them on which questions of reach are answered for all nodes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.ranks import kept
from auditloom.operators.unions import LINKS_A_TASK


def _parts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, part) of links: each node with the least of its strongly connected part, by Tarjan's search without recursion."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    order = np.argsort(x, kind="stable")
    to, begin = y[order].tolist(), np.searchsorted(x[order], np.arange(len(nodes) + 1)).tolist()
    index, low, part = [-1] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
    next_ = begin[:-1]
    held: list[int] = []
    n = 0
    for first in range(len(nodes)):
        if index[first] >= 0:
            continue
        index[first] = low[first] = n
        n += 1
        held.append(first)
        way = [first]
        while way:
            v = way[-1]
            if next_[v] < begin[v + 1]:
                w = to[next_[v]]
                next_[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = n
                    n += 1
                    held.append(w)
                    way.append(w)
                elif part[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
                continue
            way.pop()
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
            if low[v] == index[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(held.pop())
                least = min(members)
                for m in members:
                    part[m] = least
    return nodes, nodes[np.array(part, dtype=np.int64)]


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
        if held:
            node, part = _parts(*(np.concatenate(side) for side in zip(*held)))
            for at in range(0, len(node), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 50_000]), pa.array(part[at : at + 50_000])], names=["node", "part"])

    return links.coalesce(1).mapInArrow(run, "node long, part long")


def parts(edges: DataFrame, most: int = LINKS_A_TASK, rounds: int = 1000) -> DataFrame:
    """(node, part): of each node of edges(src, dst) the least node of its strongly connected part.

    While there are more links than one task takes, nodes without incoming or outgoing links are set aside, and the
    rest takes the colour of the least node that reaches it: of each colour, the nodes from which its own node
    can be reached are a part. Links that are then left have both ends in one colour.
    """
    nodes = kept(edges.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("node")).distinct())
    links = kept(edges.where("src <> dst").select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).distinct())
    found = None

    def add(more: DataFrame) -> DataFrame:
        return more if found is None else found.unionByName(more)

    for _ in range(rounds):
        if links.count() <= most:
            found = add(kept(_in_one_task(links)))
            break
        inner = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        inner = kept(inner)
        colour = _coloured(inner, rounds)
        same = inner.join(colour.select(F.col("node").alias("a"), "colour"), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("__c")), "b").where("colour = __c").select("a", "b")
        same = kept(same)
        whole = _reaching(same, colour.where("node = colour").select("node", "colour"), rounds)
        found = add(whole.select("node", F.col("colour").alias("part")))
        done = whole.select("node")
        links = kept(same.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    else:
        raise RuntimeError("strongly connected parts take more rounds than allowed")
    # What was set aside is alone.
    return kept(nodes.join(found, "node", "left").select("node", F.coalesce("part", "node").alias("part")))


def _coloured(links: DataFrame, rounds: int) -> DataFrame:
    """(node, colour): the least node that reaches each, itself included."""
    seen = kept(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("colour", F.col("node")))
    front = seen
    for _ in range(rounds):
        step = front.join(links, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("__new"))
        front = kept(step.join(seen, "node").where("__new < colour").select("node", F.col("__new").alias("colour")))
        if front.isEmpty():
            return seen
        seen = kept(seen.join(front.withColumnRenamed("colour", "__new"), "node", "left").select("node", F.coalesce("__new", "colour").alias("colour")))
    raise RuntimeError("colours take more rounds than allowed")


def _reaching(links: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """(node, colour): nodes that reach the node of start(node, colour) over links of one colour."""
    seen = front = kept(start)
    for _ in range(rounds):
        step = front.join(links, F.col("node") == F.col("b")).select(F.col("a").alias("node"), "colour").distinct()
        front = kept(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = kept(seen.unionByName(front))
    raise RuntimeError("the search takes more rounds than allowed")


def quotient(edges: DataFrame, most: int = LINKS_A_TASK) -> tuple[DataFrame, DataFrame]:
    """((node, q, end), links (a, b) between q): a graph without cycles in which strongly connected parts are one each.

    A node that no edge enters is taken together with those that lead to the same parts, one that no edge leaves
    with those that the same parts lead to; end is true for these, as two of them never reach each other. So far as
    reach goes, all nodes of a q are alike, but for whether they reach one another. q is its least node.
    Equal sets of parts are told by their size and 128 bits of hash.
    """
    of = parts(edges, most)
    ends = [of.select(F.col("node").alias(side), F.col("part").alias(name)) for side, name in (("src", "a"), ("dst", "b"))]
    joined = edges.select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst")
    between = kept(joined.where("a <> b").select("a", "b").distinct())
    # A part that links lead into and out of, or with links inside, isn't an end.
    inside = joined.where("a = b").select(F.col("a").alias("part")).distinct()
    mark = lambda x: [F.count("*").alias("n"), *(F.expr(f"bit_xor(xxhash64({x}, {i}))").alias(f"h{i}") for i in (1, 2))]
    alike = []
    for mine, other in (("a", "b"), ("b", "a")):
        tips = between.select(F.col(mine).alias("part")).distinct().join(between.select(F.col(other).alias("part")).distinct(), "part", "left_anti").join(inside, "part", "left_anti")
        sets = between.withColumnRenamed(mine, "part").join(tips, "part", "left_semi").groupBy("part").agg(*mark(other))
        least = kept(sets).groupBy("n", "h1", "h2").agg(F.min("part").alias("q"))
        alike.append(sets.join(least, ["n", "h1", "h2"]).select("part", "q"))
    alike = kept(alike[0].unionByName(alike[1]))
    named = kept(of.join(alike, "part", "left").select("node", F.coalesce("q", "part").alias("q"), F.col("q").isNotNull().alias("end")))
    ids = alike.withColumnRenamed("q", "__q")
    links = between
    for side in ("a", "b"):
        links = links.join(ids.withColumnRenamed("part", side), side, "left").withColumn(side, F.coalesce("__q", side)).drop("__q")
    return named, kept(links.select("a", "b").distinct())

"""Features of nodes from text, behaviour and vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import dot, l2, normalised, prefixes, unit_range, word_weights
from auditloom.operators.scoring import mean_vectors, relation_counts
from auditloom.operators.windows import idle_gaps


def corpus(nodes: DataFrame, tokens: Column) -> DataFrame:
    """L1: (label, node, tokens): each label once, with its least node."""
    return nodes.groupBy("label").agg(F.min("node").alias("node")).withColumn("tokens", tokens)


def neighbour_corpus(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """L2: (node, tokens): a node's tokens and then those of its out-neighbours in the order of first contact; nodes(node, tokens)."""
    first = edges.groupBy("src", "dst").agg(F.min(F.struct("t", "event_id")).alias("at"))
    around = first.join(nodes.select(F.col("node").alias("dst"), F.col("tokens").alias("other")), "dst")
    lists = around.groupBy(F.col("src").alias("node")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "other"))), lambda x: x["other"])).alias("more"))
    return nodes.join(lists, "node", "left").select("node", F.concat("tokens", F.coalesce("more", F.array().cast("array<string>"))).alias("tokens"))


def documents(edges: DataFrame, by: str = "w", most: int = 300) -> DataFrame:
    """L3: (by, node, items): operations and partners of a node in the order of time, while there are fewer than `most` items before."""
    ends = edges.select(by, "t", "event_id", "op", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"))
    w = Window.partitionBy(by, "e.node").orderBy("t", "event_id", "e.other")
    # Each event brings three items, so the cap is known by rank.
    kept = ends.withColumn("rn", F.row_number().over(w) - 1).where(F.col("rn") * 3 < most)
    items = F.sort_array(F.collect_list(F.struct("rn", F.array(F.col("e.node").cast("string"), F.col("op"), F.col("e.other").cast("string")).alias("i"))))
    return kept.groupBy(by, "e.node").agg(F.flatten(F.transform(items, lambda x: x["i"])).alias("items"))


def word_vectors(docs: DataFrame, size: int = 32, window: int = 5, least: int = 1, rounds: int = 1, seed: int = 0) -> DataFrame:
    """L4: (token, vector) by skip-gram over docs(tokens), of tokens that occur at least so often. The vocabulary, not the corpus, is held by the driver."""
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, inputCol="tokens", outputCol="__out").fit(docs.where(F.size("tokens") > 0).select("tokens"))
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def _summed(rows: DataFrame, key: str, vector: Column, weight: Column) -> DataFrame:
    """(key, vector): the weighted sum of the vectors of each key; tasks send one vector a key."""
    scaled = rows.select(key, array_to_vector(F.transform(vector.cast("array<double>"), lambda x: x * weight)).alias("__v"))
    return scaled.groupBy(key).agg(vector_to_array(Summarizer.sum(F.col("__v"))).alias("vector"))


def weighted_vectors(docs: DataFrame, vectors: DataFrame, percent: float = 0.0) -> DataFrame:
    """(node, vector): of docs(node, tokens) the weighted sum of token vectors(token, vector) to norm 1; unknown tokens are 0."""
    weights = docs.select("node", F.posexplode("tokens").alias("i", "token"), word_weights(F.size("tokens"), percent).alias("ws"))
    rows = weights.select("node", "token", F.element_at("ws", F.col("i") + 1).alias("wt")).join(vectors, "token")
    return _summed(rows, "node", F.col("vector"), F.col("wt")).select("node", normalised(F.col("vector")).alias("vector"))


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 of 32 bits, signed."""
    full = 0xFFFFFFFF
    spin = lambda x, r: (x << r | x >> (32 - r)) & full
    scatter = lambda k: spin(k * 0xCC9E2D51 & full, 15) * 0x1B873593 & full
    h, whole = seed, len(data) // 4 * 4
    for at in range(0, whole, 4):
        h = (spin(h ^ scatter(int.from_bytes(data[at : at + 4], "little")), 13) * 5 + 0xE6546B64) & full
    if data[whole:]:
        h ^= scatter(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & full
    return h - (1 << 32) if h >> 31 else h


def hashed_characters(texts: DataFrame, dims: int, key: str = "node", text: str = "text") -> DataFrame:
    """(key, vector): each character adds the sign of its hash at the place that the hash gives it; to norm 1. Null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            out = np.zeros((len(pdf), dims))
            for row, value in zip(out, pdf["__text"]):
                for c, n in Counter(value).items():
                    if c not in known:
                        h = murmur3(c.encode())
                        known[c] = (abs(h) % dims, 1 if h >= 0 else -1)
                    row[known[c][0]] += known[c][1] * n
            out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-12
            yield pd.DataFrame({"__key": pdf["__key"], "vector": list(out)})

    named = texts.select(F.col(key).cast("string").alias("__key"), F.coalesce(text, F.lit("")).alias("__text"))
    return named.mapInPandas(run, "__key string, vector array<double>").select(F.col("__key").cast(texts.schema[key].dataType).alias(key), "vector")


def hierarchical_hashes(nodes: DataFrame, dims: int = 128) -> DataFrame:
    """(node, vector) of nodes(node, type, label): characters of all beginnings of a path, or of an address, one after the other."""
    begins = F.when(F.col("type").isin("subject", "file"), prefixes(F.trim("label"))).otherwise(prefixes(F.trim("label"), "."))
    return hashed_characters(nodes.select("node", F.array_join(begins, "").alias("text")), dims)


def behaviour(edges: DataFrame, ops: list[str]) -> DataFrame:
    """(node, in_*, out_*, gap_*, lifespan, active): counts by operation, to norm 1 in each node, and idle times, each scaled to [0, 1] over all nodes."""
    counts = relation_counts(edges, "split").groupBy("node", "op").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    wide = counts.groupBy("node").agg(*(F.coalesce(F.sum(F.when(F.col("op") == o, F.col(f"n_{d}"))), F.lit(0)).cast("double").alias(f"{d}_{o}") for o in ops for d in ("in", "out")))
    names = [c for c in wide.columns if c != "node"]
    norm = F.sqrt(sum((F.col(f"`{n}`") * F.col(f"`{n}`") for n in names), F.lit(0.0)))
    shares = wide.select("node", *(F.coalesce(F.try_divide(F.col(f"`{n}`"), norm), F.lit(0.0)).alias(n) for n in names))
    idle = idle_gaps(edges)
    times = [c for c in idle.columns if c != "node"]
    span = idle.agg(*(f(n).cast("double").alias(f"{k}_{n}") for n in times for k, f in (("lo", F.min), ("hi", F.max))))
    scaled = idle.crossJoin(F.broadcast(span)).select("node", *(unit_range(F.col(n).cast("double"), F.col(f"lo_{n}"), F.col(f"hi_{n}")).alias(n) for n in times))
    return shares.join(scaled, "node")


def summed_neighbours(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, vector): the sum of the vectors(node, vector) of its in-neighbours."""
    rows = edges.select("src", F.col("dst").alias("node")).join(vectors.withColumnRenamed("node", "src"), "src")
    return _summed(rows, "node", F.col("vector"), F.lit(1.0))


def one_class(train: DataFrame, rows: DataFrame, kind: str = "label", vector: str = "embedding", beta: float = 0.05, eps: float = 0.1) -> DataFrame:
    """Rows with `score` = |h - c|^2 - r^2 by kind: c is the mean of train, kept off 0 by eps, r the quantile 1 - beta of distances."""
    centre = mean_vectors(train, kind, vector).select(kind, F.transform(vector, lambda x: F.when(F.abs(x) < eps, F.when(x < 0, -eps).otherwise(eps)).otherwise(x)).alias("c"))
    far = lambda df: df.join(F.broadcast(centre), kind).withColumn("d2", F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "c", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)).drop("c")
    radius = far(train).groupBy(kind).agg(F.percentile(F.sqrt("d2"), 1 - beta).alias("r"))
    return far(rows).join(F.broadcast(radius), kind).withColumn("score", F.col("d2") - F.col("r") * F.col("r")).drop("d2", "r")


def confidence(probabilities: Column) -> tuple[Column, Column]:
    """The log ratio of the two greatest probabilities, at least 0; and the relative margin of the two greatest outputs."""
    top = F.sort_array(probabilities, asc=False)
    one, two = F.element_at(top, 1), F.element_at(top, 2)
    return F.greatest(F.ln(one / two + 1e-12), F.lit(0.0)), (one - two) / (one + 1e-6)


def losses(prediction: Column, target: Column, alpha: int = 3) -> dict[str, Column]:
    """By name: scaled cosine error, and squared and absolute errors summed over the vector."""
    cos = F.try_divide(dot(prediction, target), l2(prediction) * l2(target))
    pairs = lambda f: F.aggregate(F.zip_with(prediction.cast("array<double>"), target.cast("array<double>"), f), F.lit(0.0), lambda s, x: s + x)
    return {"sce": F.pow(1 - cos, F.lit(alpha)), "mse": pairs(lambda x, y: (x - y) * (x - y)), "mae": pairs(lambda x, y: F.abs(x - y))}


def cross_entropy(logits: Column, kind: Column) -> Column:
    """-log softmax at the true class, counted from 0."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.ln(total) + top - F.element_at(logits, kind + 1)


def binary_cross_entropy(logit: Column, y: Column) -> Column:
    """Stable for large logits."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def _nearest(x: np.ndarray, to: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places) of the k nearest rows of `to` for each row of x, nearest first; skip marks pairs that don't count.

    Products find a few more than k, whose distances are then taken from the differences.
    """
    some = min(len(to), k + 8)
    near = (to * to).sum(axis=1)[None, :] - 2 * (x @ to.T)
    if skip is not None:
        near[skip] = np.inf
    place = np.argpartition(near, some - 1, axis=1)[:, :some] if some < len(to) else np.tile(np.arange(len(to)), (len(x), 1))
    gap = np.sqrt(((x[:, None, :] - to[place]) ** 2).sum(axis=2))
    if skip is not None:
        gap[np.take_along_axis(skip, place, axis=1)] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(gap, order, axis=1), np.take_along_axis(place, order, axis=1)


def _sample(train: DataFrame, key: str, vector: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, vectors) of the bounded sample of least hash."""
    rows = train.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(key, F.col(vector).cast("array<double>").alias(vector)).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)


def _scored(rows: DataFrame, key: str, vector: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(key, score) of rows, some at a time; score takes their vectors and keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                some = pdf.iloc[at : at + 128]
                yield pd.DataFrame({key: some[key], "score": score(np.stack(some[vector]).astype(np.float64), some[key].to_numpy())})

    return rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, f"{key} long, score double")


def knn_outliers(train: DataFrame, rows: DataFrame, k: int = 10, sample: int = 5000) -> DataFrame:
    """(vec_id, score): the mean distance to the k nearest of a bounded sample of train, over the sample's own mean of that.

    Dimensions are standardised by the sample's means and deviations; one that is constant there is only
    centred. A row isn't its own neighbour. The sample of least hash is sent to all tasks, and nothing is shuffled.
    """
    ids, x = _sample(train, "vec_id", "embedding", sample)
    if len(ids) < 2:
        return rows.select(F.col("vec_id").cast("long"), F.lit(None).cast("double").alias("score"))
    mean, dev = x.mean(axis=0), x.std(axis=0)
    dev = np.where(dev > 0, dev, 1.0)
    z = (x - mean) / dev
    far = lambda v, own: _nearest(v, z, min(k, len(z) - 1), own[:, None] == ids[None, :])[0].mean(axis=1)
    # Of equal vectors alone the mean is 0, and the reference divides by a trifle.
    base = float(np.concatenate([far(z[at : at + 128], ids[at : at + 128]) for at in range(0, len(z), 128)]).mean()) or 1e-9
    return _scored(rows, "vec_id", "embedding", lambda v, own: far((v - mean) / dev, own) / base)


def novelty(train: DataFrame, rows: DataFrame, k: int = 30, sample: int = 5000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): 1.5 less the local outlier factor against a bounded sample of train; below 0 a row is an outlier.

    Densities are those of the k nearest rows of the sample, which are not themselves; a row to be judged is new,
    so that an equal row of the sample is its neighbour.
    """
    ids, x = _sample(train, key, vector, sample)
    if len(ids) < 2:
        return rows.select(F.col(key).cast("long"), F.lit(None).cast("double").alias("score"))
    k = min(k, len(x) - 1)
    parts = [_nearest(x[at : at + 128], x, k, np.arange(at, min(at + 128, len(x)))[:, None] == np.arange(len(x))[None, :]) for at in range(0, len(x), 128)]
    gap, place = (np.concatenate(p) for p in zip(*parts))
    reach = gap[:, -1]
    density = 1 / (np.maximum(gap, reach[place]).mean(axis=1) + 1e-10)

    def score(v: np.ndarray, _: np.ndarray) -> np.ndarray:
        far, near = _nearest(v, x, k)
        own = 1 / (np.maximum(far, reach[near]).mean(axis=1) + 1e-10)
        return 1.5 - density[near].mean(axis=1) / own

    return _scored(rows, key, vector, score)


def negatives(edges: DataFrame, by: str = "w", seed: int = 0) -> DataFrame:
    """(src, dst): each edge with the target of another edge of its group, next in a hashed order; loops and edges that exist drop out."""
    w = Window.partitionBy(by).orderBy(F.xxhash64("event_id", F.lit(seed)), "event_id")
    pairs = edges.select("src", F.lead("dst").over(w).alias("dst")).where("dst is not null and src <> dst")
    return pairs.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")

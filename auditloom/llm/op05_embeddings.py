"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors at a cosine of c lie sqrt(2 - 2c) apart. Each of several tables projects them on random
Gaussian directions, cuts the projections into cells and hashes the cells together; vectors in the same
cell of any table are compared in double precision. Found links are counted where they are found, in the
first table that two vectors share, and only spanning trees of them leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import arrow_map, durable, join_group_facts, pandas_map, release
from auditloom.llm.components import components

#: Width of a cell, and the share of pairs exactly at the threshold that the tables must find together.
WIDTH = 2.2
RECALL = 0.95
#: Unrelated rows that share a cell with a row. More of them make cells coarser and tables fewer: products are cheap, rows of tables are not.
FAR = 32
BLOCK = 512
#: Groups of at most so many vectors are compared many at a time.
SMALL = 32


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one projection puts two points into the same cell."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(rows: int, cosine: float) -> tuple[int, int]:
    """(projections a table, tables): unrelated rows (at right angles) share a cell with about FAR rows each.

    Tables grow with the rows to a power of about 0.34: 10 at 2,000 rows, 28 at 51,282, 75 at 1e6, 360 at 1e8.
    """
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(rows, 2) / FAR) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log1p(-(near**k)))


def hashes(vectors: np.ndarray, k: int, tables: int, seed: int = 3) -> np.ndarray:
    """[row, table]: 32-bit cells of unit vectors; directions depend on the seed and dimension only."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    directions, shift = rng.normal(size=(vectors.shape[1], tables * k)), rng.uniform(0, WIDTH, tables * k)
    lanes = rng.integers(1, 1 << 63, (tables, k), dtype=np.uint64) | np.uint64(1)
    cells = np.floor((vectors @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, k)
    mixed = (cells * lanes).sum(axis=2, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    # Scaled first: squares of very large or small components stay finite.
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _labels(mask: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric mask reaches."""
    label = np.arange(len(mask))
    while True:
        new = np.minimum(label, np.where(mask, label[None, :], len(mask)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _found(pdf: pd.DataFrame, starts: np.ndarray, kind: str, cosine: float) -> pd.DataFrame:
    """(u, links, root) of the groups that begin at starts[:-1]: new links of u by copies, and a vector linked with u."""
    out = [np.zeros((0, 3), np.int64)]
    u, copies, own = (pdf[c].to_numpy() for c in ("u", "copies", "own"))
    across = pdf["i"].to_numpy() != pdf["j"].to_numpy()
    sizes = np.diff(starts)
    for size in np.unique(sizes[sizes > 1]):
        at = starts[:-1][sizes == size]
        step = max(1, SMALL * SMALL * 64 // (size * size))
        for part in range(0, len(at), step):
            rows = at[part : part + step, None] + np.arange(size)
            groups = [rows] if size <= SMALL else [rows[k : k + 1] for k in range(len(rows))]
            for rows in groups:
                flat = rows.ravel()
                some = pdf.iloc[flat]
                for dim in np.unique(some["dim"].to_numpy()[::size]):
                    mine = rows[some["dim"].to_numpy()[::size] == dim]
                    unit = _unit(np.frombuffer(b"".join(pdf["raw"].iloc[mine.ravel()]), dtype=kind).reshape(-1, dim)).reshape(len(mine), size, dim)
                    mask = unit @ unit.transpose(0, 2, 1) >= cosine
                    mask &= ~np.eye(size, dtype=bool)
                    # Groups of two blocks compare across them only.
                    two = across[mine[:, 0]]
                    mask &= ~two[:, None, None] | (own[mine][:, :, None] != own[mine][:, None, :])
                    g, a, b = np.nonzero(mask)
                    if not len(g):
                        continue
                    x, y = mine[g, a], mine[g, b]
                    fresh = np.empty(len(x), dtype=bool)
                    for c in range(0, len(x), 1 << 14):
                        pair = [np.frombuffer(b"".join(pdf["before"].iloc[z[c : c + (1 << 14)]]), np.uint32) for z in (x, y)]
                        # Groups of different tables know different numbers of earlier cells.
                        lengths = pdf["before"].iloc[x[c : c + (1 << 14)]].str.len().to_numpy() // 4
                        same = np.concatenate([[0], np.cumsum(pair[0] == pair[1])])
                        ends = np.cumsum(lengths)
                        fresh[c : c + (1 << 14)] = same[ends] == same[ends - lengths]
                    if size <= SMALL:
                        out.append(np.stack([u[x], copies[y] * fresh, u[y]], axis=1))
                    else:
                        links = np.bincount(a[fresh], weights=copies[y[fresh]], minlength=size).astype(np.int64)
                        linked = mask[0].any(axis=1)
                        out.append(np.stack([u[mine[0]], links, u[mine[0]][_labels(mask[0])]], axis=1)[linked])
    return pd.DataFrame(np.concatenate(out), columns=["u", "links", "root"])


def near_vectors(rows: DataFrame, cosine: float = 0.9, vector: str = "embedding", key: str = "vec_id", seed: int = 3) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Linked rows have a cosine of at least `cosine` in double precision. Null, empty and zero vectors, those
    with null or non-finite components, and vectors of unlike lengths link with nothing. Equal vectors are
    linked and go through the tables as one. Rows repeated with the same key count as rows of their own, null
    keys too: a component is named by its least key, null only if none of its rows has one. Other columns are
    ignored; an empty table gives an empty result.
    """
    double = isinstance(rows.schema[vector].dataType.elementType, T.DoubleType)
    kind = "<f8" if double else "<f4"
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                raw = None if v is None else np.array(v, dtype=np.float64)
                ok = raw is not None and len(raw) and np.isfinite(raw).all() and raw.any()
                out.append((raw.astype(kind) + 0).tobytes() if ok else None)  # + 0: no negative zero
            yield {"id": batch.column("id"), "raw": out}

    packed = durable(arrow_map(given, pack, "id long, raw binary").withColumn("digest", F.sha2("raw", 256)))
    valid = packed.where(F.col("raw").isNotNull())
    reps = valid.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    # The number of a vector stands for it from here on, as keys may repeat; it lasts, as the table is written first.
    reps = durable(reps.select("digest", "copies", "raw", "rep", F.monotonically_increasing_id().alias("u")))
    k, tables = parameters(reps.count(), cosine)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["raw"].str.len().to_numpy()
            for size in np.unique(sizes):
                part = pdf[sizes == size]
                for at in range(0, len(part), 2048):
                    some = part.iloc[at : at + 2048]
                    raw = np.frombuffer(b"".join(some["raw"]), dtype=kind).reshape(len(some), -1)
                    found = hashes(_unit(raw), k, tables, seed)
                    yield pd.DataFrame({"u": some["u"], "dim": np.int32(raw.shape[1]), "cells": [r.tobytes() for r in found], "cell": list(found.astype(np.int64))})

    hashed = durable(pandas_map(reps.select("u", "raw"), cells, "u long, dim int, cells binary, cell array<long>"))
    in_cell = hashed.select("u", "dim", F.posexplode("cell").alias("t", "c"))
    counted = in_cell.groupBy("t", "c", "dim").agg(F.count("*").alias("n_in")).where("n_in > 1")
    members = join_group_facts(in_cell, counted, ["t", "c", "dim"], "n_in").withColumn("blocks", F.ceil(F.col("n_in") / BLOCK).cast("int"))
    members = members.withColumn("own", F.pmod("u", F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = reps.select("u", "copies", "raw").join(hashed.select("u", "cells"), "u")
    # Earlier tables tell whether a pair was met before.
    dealt = members.join(full, "u").select("t", "c", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "u", "copies", "raw", F.expr("substring(cells, 1, 4 * t)").alias("before"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            name = pdf[["t", "c", "dim", "i", "j"]].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1]) if len(pdf) else np.zeros(1, int)
            held = pdf.iloc[starts[-1] :]  # the last group may go on in the next batch
            yield _found(pdf.iloc[: starts[-1]], starts, kind, cosine)
        if held is not None:
            yield _found(held, np.array([0, len(held)]), kind, cosine)

    group = ["t", "c", "dim", "i", "j"]
    found = durable(pandas_map(dealt.repartition(*group).sortWithinPartitions(*group), compare, "u long, links long, root long"))
    release(rows.sparkSession)
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    # Components by numbers of vectors, then by the least key in each.
    joined = components(found.select(F.col("u").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"id": "u", "component": "c"})
    facts = durable(reps.select("digest", "copies", "rep", "u").join(counts, "u", "left").join(joined, "u", "left").select("digest", "copies", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("c", "u").alias("c")))
    least = facts.groupBy("c").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_in"))
    facts = join_group_facts(facts, least, ["c"], "n_in").select("digest", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = join_group_facts(valid.select("id", "digest"), facts, ["digest"], "copies").select("id", "n_links", "component_id")
    alone = packed.where(F.col("raw").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

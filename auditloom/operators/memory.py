"""A memory of verified incidents: admission, signatures, and retrieval by similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.scalars import l2
from auditloom.operators.graph import _kept as durable
from auditloom.operators.scoring import mean_vectors

#: Of nearest references a task holds about so many rows a label, and so many labels.
PENDING = 500_000
LABELS_HELD = 64
LABELS = ("malicious", "benign")
COLUMNS = ("entry_id", "label", "source_id", "host_id", "techniques", "events", "fingerprint")


def fingerprint(events: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint) of evidence (src, dst, t, op): scores take no part, and order doesn't matter.

    Events are hashed one by one, and four 60-bit pieces of their hashes are summed: nothing is gathered or sorted.
    """
    one = F.sha2(F.concat_ws("|", F.col("t").cast("string"), F.col("src").cast("string"), F.col("dst").cast("string"), "op"), 256)
    pieces = [F.conv(F.substring(one, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16, 31, 46)]
    sums = events.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(pieces)))
    return sums.select(key, F.sha2(F.concat_ws(",", *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3"))), 256).alias("fingerprint"))


def checked(entries: DataFrame) -> DataFrame:
    """M1, M2: entries (COLUMNS) that may be admitted; the others are an error that names the first."""
    ok = (F.length("entry_id") > 0) & (F.length("source_id") > 0) & (F.length("host_id") > 0) & F.col("label").isin(*LABELS) & (F.size("events") > 0) & (F.size("techniques") == F.size(F.array_distinct("techniques")))
    ok = ok & ~((F.col("label") == "benign") & (F.size("techniques") > 0))
    proper = F.coalesce(ok, F.lit(False))
    return entries.withColumn("entry_id", F.when(proper, F.col("entry_id")).otherwise(F.raise_error(F.concat(F.lit("not admissible: "), F.coalesce("entry_id", F.lit("null")))).cast("string")))


def add(store: str, entries: DataFrame) -> None:
    """Appends entries below the path; an id that is there already, or comes twice, is an error."""
    spark = entries.sparkSession
    twice = entries.groupBy("entry_id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("an entry comes twice")
    try:
        old = spark.read.parquet(store)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = None
    if old is not None and not old.join(entries, "entry_id", "left_semi").isEmpty():
        raise ValueError("an entry is stored already")
    body = F.to_json(F.struct(*[c for c in entries.columns]))
    checked(entries).withColumn("checksum", F.sha2(body, 256)).write.mode("append").parquet(store)


def entries(spark, store: str) -> DataFrame:
    """M3: all entries by id; an entry that was changed is an error."""
    df = spark.read.parquet(store)
    columns = [c for c in df.columns if c != "checksum"]
    intact = F.sha2(F.to_json(F.struct(*columns)), 256) == F.col("checksum")
    return df.withColumn("entry_id", F.when(intact, F.col("entry_id")).otherwise(F.raise_error(F.lit("an entry was changed")).cast("string"))).drop("checksum").orderBy("entry_id")


def dimension(semantic: int, types: int, relations: int) -> int:
    """M4: of a signature: unknown types and relations have a bin of their own."""
    return semantic + (types + 1) + (relations + 1) + (relations + 1) ** 2


def _block(counts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, block): counts (key, bin, n) as a vector of norm one half, by bin."""
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return norm.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm") * 0.5).alias("block"))


def _bin(value: Column, vocabulary: tuple[str, ...]) -> Column:
    out = F.lit(len(vocabulary))
    for i, v in enumerate(vocabulary):
        out = F.when(value == v, i).otherwise(out)
    return out


def signatures(events: DataFrame, nodes: DataFrame, types: tuple[str, ...], relations: tuple[str, ...], key: str = "entry_id", budget: int = 1_000_000, vectors: DataFrame | None = None, semantic: int = 0) -> DataFrame:
    """(key, signature): the mean vector of the nodes, and histograms of node types, of relations and of pairs of consecutive relations on paths of two events.

    events: (key, event_id, src, dst, t, op); nodes: (key, node, type); vectors: (key, node, vector) of `semantic`
    numbers each, whose block comes first; without them there is none. Each block has the norm one half, or 0 if
    nothing is in it; the last bin is for what isn't in the vocabulary. More paths than the budget in one entry, and
    vectors of another length, are errors.
    """
    a = nodes.groupBy(key, _bin(F.col("type"), types).alias("bin")).agg(F.count("*").alias("n"))
    b = events.groupBy(key, _bin(F.col("op"), relations).alias("bin")).agg(F.count("*").alias("n"))
    k = len(relations) + 1
    into = events.select(key, F.col("event_id").alias("e1"), F.col("dst").alias("mid"), F.col("t").alias("t1"), _bin(F.col("op"), relations).alias("r1"))
    out = events.select(key, F.col("event_id").alias("e2"), F.col("src").alias("mid"), F.col("t").alias("t2"), _bin(F.col("op"), relations).alias("r2"))
    paths = into.join(out, [key, "mid"]).where("t1 <= t2 and e1 <> e2")
    c = paths.groupBy(key, (F.col("r1") * k + F.col("r2")).alias("bin")).agg(F.count("*").alias("n"))
    if not c.groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") > budget).isEmpty():
        raise RuntimeError("more paths than the budget")
    blocks = [(_block(a, key, len(types) + 1), len(types) + 1), (_block(b, key, k), k), (_block(c, key, k * k), k * k)]
    out_, parts = events.select(key).distinct(), []
    if vectors is not None:
        size = F.size("vector")
        right = F.when(size == semantic, F.col("vector")).otherwise(F.raise_error(F.lit("a vector of another length")).cast("array<double>"))
        mean = mean_vectors(vectors.withColumn("vector", right), key, "vector")
        out_ = out_.join(mean.select(key, F.transform("vector", lambda x: F.coalesce(F.try_divide(x, l2(F.col("vector"))), F.lit(0.0)) * 0.5).alias("semantic")), key, "left")
        parts.append(F.coalesce("semantic", F.array_repeat(F.lit(0.0), semantic)))
    for i, (block, size) in enumerate(blocks):
        out_ = out_.join(block.withColumnRenamed("block", f"b{i}"), key, "left")
        parts.append(F.coalesce(f"b{i}", F.array_repeat(F.lit(0.0), size)))
    return out_.select(key, F.concat(*parts).alias("signature"))


def _unit(signatures: pd.Series) -> np.ndarray:
    """Rows of norm one; a zero vector stays zero, so that its similarity is 0."""
    raw = np.stack([np.asarray(x, np.float64) for x in signatures])
    norms = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    return np.divide(raw, norms, out=np.zeros_like(raw), where=norms > 0)


class _Nearest:
    """Of each query the k nearest of the references so far, ties by id; holds at most about PENDING rows."""

    def __init__(self, n: int, k: int, at: float):
        self.k, self.at, self.best, self.rows, self.n = k, at, np.full((n, k), -np.inf), [], 0

    def add(self, s: np.ndarray, ids: np.ndarray, labels: np.ndarray, exact) -> None:
        both = np.concatenate([self.best, s], axis=1)
        self.best = np.partition(both, -self.k, axis=1)[:, -self.k :]
        # The product of matrices may differ in its last bits from row to row: pairs near the limit are taken along.
        q, r = np.nonzero(s >= np.maximum(self.best.min(axis=1), self.at)[:, None] - 1e-9)
        if len(q):
            self.rows.append(pd.DataFrame({"q": q, "entry_id": ids[r], "label": labels[r], "similarity": exact(q, r)}))
            self.n += len(q)
            if self.n > PENDING:
                self.prune()

    def prune(self) -> pd.DataFrame | None:
        if not self.rows:
            return None
        rows = pd.concat(self.rows, ignore_index=True)
        rows = rows[rows["similarity"] >= self.at].sort_values(["q", "similarity", "entry_id"], ascending=[True, False, True])
        rows = rows.groupby("q", sort=False).head(self.k)
        self.rows, self.n = [rows], len(rows)
        return rows


def _block_scores(block: DataFrame, references: DataFrame, k: int, at: float) -> DataFrame | None:
    """(query, entry_id, label, similarity, strong): what each partition has for a block of queries."""
    asked = block.select("query", "signature").where("signature is not null").toPandas()
    if asked.empty:
        return None
    sent = references.sparkSession.sparkContext.broadcast((asked["query"].to_numpy(), _unit(asked["signature"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted = sent.value
        any_, by_label = _Nearest(len(names), 1, -np.inf), {}

        def out(found: _Nearest, strong: bool) -> Iterator[pd.DataFrame]:
            rows = found.prune()
            if rows is not None and len(rows):
                yield pd.DataFrame({"query": names[rows["q"]], "entry_id": rows["entry_id"], "label": rows["label"], "similarity": rows["similarity"], "strong": strong})

        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                part = pdf.iloc[start : start + 1000]
                unit, ids, labels = _unit(part["signature"]), part["entry_id"].to_numpy(), part["label"].to_numpy()
                s = np.clip(wanted @ unit.T, -1.0, 1.0)

                def exact(q: np.ndarray, r: np.ndarray) -> np.ndarray:
                    return np.concatenate([np.clip(np.einsum("ij,ij->i", wanted[q[i : i + 50_000]], unit[r[i : i + 50_000]]), -1.0, 1.0) for i in range(0, len(q), 50_000)])

                any_.add(s, ids, labels, exact)
                for label in pd.unique(labels):
                    own = np.flatnonzero(labels == label)
                    pick = lambda q, r, own=own: exact(q, own[r])
                    by_label.setdefault(label, _Nearest(len(names), k, at)).add(s[:, own], ids[own], labels[own], pick)
                if len(by_label) > LABELS_HELD:
                    for found in by_label.values():
                        yield from out(found, True)
                    by_label = {}
        for found in by_label.values():
            yield from out(found, True)
        yield from out(any_, False)

    kinds = {**dict(references.dtypes), **dict(block.dtypes)}
    schema = f"query {kinds['query']}, entry_id {kinds['entry_id']}, label {kinds['label']}, similarity double, strong boolean"
    return references.select("entry_id", "label", "signature").where("signature is not null").mapInPandas(scan, schema)


def retrieve(queries: DataFrame, references: DataFrame, k: int, at: float, block: int = 2048) -> DataFrame:
    """Of each query (query, signature) and label the k most similar references (entry_id, label, signature) at or above the threshold.

    A query without any gets its closest reference of all with strong = false. Queries may be as many as the
    references: they go out in blocks of about the given size, and each partition of the references returns
    only its own nearest ones.
    """
    asked = durable(queries.select("query", "signature"))
    blocks = max(1, math.ceil(asked.count() / block))
    order = [F.col("similarity").desc(), F.col("entry_id")]
    done = asked.sparkSession.createDataFrame([], "none int").select(*(F.lit(None).cast(t).alias(c) for c, t in (("query", dict(asked.dtypes)["query"]), ("entry_id", dict(references.dtypes)["entry_id"]), ("label", dict(references.dtypes)["label"]), ("similarity", "double"), ("rank", "long"), ("strong", "boolean"))))
    for i in range(blocks):
        scored = _block_scores(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i), references, k, at)
        if scored is None:
            continue
        scored = durable(scored)
        strong = scored.where("strong").withColumn("rank", F.row_number().over(Window.partitionBy("query", "label").orderBy(*order)).cast("long")).where(F.col("rank") <= k)
        closest = scored.where("not strong").groupBy("query").agg(F.min_by(F.struct("entry_id", "label", "similarity"), F.struct(-F.col("similarity"), "entry_id")).alias("c")).select("query", "c.*", F.lit(1).cast("long").alias("rank"), F.lit(False).alias("strong"))
        weak = closest.join(strong.select("query").distinct(), "query", "left_anti")
        done = done.unionByName(durable(strong.select(*done.columns).unionByName(weak.select(*done.columns))))
    return done

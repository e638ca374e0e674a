"""Toxicity by a factorization machine over hashed terms.

The score of a document with the set of terms S is the logistic function of
b + sum w_i + sum over pairs <v_i, v_j>: beside the weight of each term the model learns how pairs of
terms act together, which additive weights miss. Terms are the distinct words of the whole text and the
beginnings of its longer words, which stand for inflected forms. Terms take part whose presence tells of the
label by a likelihood-ratio test, or which do so in a pair: among texts with the one term, the other tells, and
the other way round. A long clean text is then no sum of small accidents, and terms that are neutral alone can
still act together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import arrow_map, durable, slices, text_or_empty

#: The bounds of the sample of labelled rows that the model is fitted on, those of least hash: rows, and bytes of their terms.
SAMPLE_ROWS = 16_000
SAMPLE_BYTES = 64 << 20
BUCKETS = 1 << 18
FACTORS = 6
EPOCHS = 30
THRESHOLD = 0.7
STEMS = (3, 4, 5)
#: The least likelihood-ratio statistic of a term that takes part.
TELLING = 12.0
#: The same for either term of a pair, among texts with the other; pairs are tried among so many of the most frequent terms.
TELLING_PAIR = 40.0
PAIRED = 1024
#: Words that a worker remembers; it forgets them when it is full, and after each task.
_CACHE = 60_000


@dataclass
class Machine:
    """bias, weights[BUCKETS] and vectors[BUCKETS, FACTORS]: a fixed 7 MB. Buckets that take no part are 0."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of documents whose distinct buckets are ids[starts[i]:starts[i + 1]]."""
        n = np.diff(starts)
        out = np.full(len(n), self.bias)
        full = n > 0
        if full.any():
            at = starts[:-1][full]
            v = self.vectors[ids]
            sums = np.add.reduceat(v, at, axis=0)
            squares = np.add.reduceat((v * v).sum(axis=1), at)
            out[full] += np.add.reduceat(self.weights[ids], at) + 0.5 * ((sums * sums).sum(axis=1) - squares)
        return out


class Terms:
    """The buckets of a text, of those that take part; words seen before are looked up."""

    def __init__(self, taking_part: np.ndarray | None = None) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.taking_part = taking_part

    def _of(self, word: str) -> tuple[int, ...]:
        core = word.strip(".,;:!?\"'()[]{}|*&%$#<>") or word
        found = [zlib.crc32(b"w" + core.encode()) % BUCKETS]
        found += [zlib.crc32(b"%d" % n + core[:n].encode()) % BUCKETS for n in STEMS if len(core) > n]
        if self.taking_part is not None:
            found = [b for b in found if self.taking_part[b]]
        if len(self.known) >= _CACHE:
            self.known.clear()
        self.known[word] = out = tuple(found)
        return out

    def of(self, text: str | None) -> np.ndarray:
        known, out = self.known, set()
        for word in set((text or "").lower().split()):
            found = known.get(word)
            if found is None:
                found = self._of(word)
            if found:
                out.update(found)
        return np.fromiter(out, dtype=np.int32, count=len(out))


def _ratio(table: np.ndarray) -> np.ndarray:
    """The likelihood-ratio statistic of 2 x 2 tables [a, b, c, d], where a and c have label 1 and a and b the term."""
    a, b, c, d = table
    n = a + b + c + d
    out = np.zeros(np.broadcast_shapes(a.shape, d.shape))
    with np.errstate(divide="ignore", invalid="ignore"):
        for cell, row, column in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
            out += np.where(cell > 0, cell * np.log(cell * n / (row * column)), 0.0)
    return 2 * out


def counted(docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the texts that have it, and those of them with label 1."""
    have, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for at in range(0, len(docs), 1024):
        part, y = docs[at : at + 1024], np.asarray(labels[at : at + 1024]) > 0
        have += np.bincount(np.concatenate(part), minlength=BUCKETS)
        if y.any():
            toxic += np.bincount(np.concatenate([d for d, bad in zip(part, y) if bad]), minlength=BUCKETS)
    return have, toxic


def alone(have: np.ndarray, toxic: np.ndarray, n: int, positive: float) -> np.ndarray:
    """Of each bucket: does it tell by itself?"""
    return _ratio(np.stack([toxic, have - toxic, positive - toxic, n - have - positive + toxic])) >= TELLING


def usual_ones(have: np.ndarray, n: int) -> np.ndarray:
    """The most frequent buckets, of which pairs are tried; what all texts or next to none hold can't tell."""
    usual = np.argsort(-np.where(have < n, have, 0), kind="stable")[:PAIRED]
    return usual[(have[usual] >= 10) & (have[usual] < n)]


def telling(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each bucket: does it take part, by itself or in a pair?"""
    n, positive = len(docs), float(np.sum(labels))
    have, toxic = counted(docs, labels)
    out = alone(have, toxic, n, positive)
    usual = usual_ones(have, n)
    place = np.full(BUCKETS, -1, np.int64)
    place[usual] = np.arange(len(usual))
    both, bad = (np.zeros((len(usual), len(usual)), np.float32) for _ in range(2))
    for at in range(0, n, 1024):
        part = docs[at : at + 1024]
        x = np.zeros((len(part), len(usual)), np.float32)
        for row, d in zip(x, part):
            at_usual = place[d]
            row[at_usual[at_usual >= 0]] = 1
        both += x.T @ x
        x = x[np.asarray(labels[at : at + 1024]) > 0]
        bad += x.T @ x
    total, total_bad = have[usual], toxic[usual]

    def within(rows: slice) -> np.ndarray:
        """Of each pair (i, j): the statistic of j among texts with i."""
        n_ij, t_ij = both[rows].astype(float), bad[rows].astype(float)
        n_i, t_i = total[rows, None], total_bad[rows, None]
        return _ratio((t_ij, n_ij - t_ij, t_i - t_ij, n_i - n_ij - t_i + t_ij))

    strong = np.zeros((len(usual), len(usual)), bool)
    for at in range(0, len(usual), 128):
        strong[at : at + 128] = within(slice(at, at + 128)) >= TELLING_PAIR
    out[usual[(strong & strong.T).any(axis=1)]] = True
    return out


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.1, decay: float = 2e-5) -> Machine:
    """Logistic loss, AdaGrad, small batches; deterministic for its input.

    Without labelled rows, or with one class only, the model is its bias.
    """
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    n, positive = len(docs), float(np.sum(labels))
    model.bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not 0 < positive < n:
        return model
    common = telling(docs, labels)
    docs = [d[common[d]] for d in docs]
    model.vectors[common] = rng.normal(0, 0.01, (int(common.sum()), FACTORS))
    seen_w, seen_v, seen_b = np.full(BUCKETS, 1e-2, np.float32), np.full((BUCKETS, FACTORS), 1e-1, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            part = order[at : at + 64]
            starts = np.concatenate([[0], np.cumsum([len(docs[i]) for i in part])])
            ids = np.concatenate([docs[i] for i in part])
            error = 1 / (1 + np.exp(-np.clip(model.logits(ids, starts), -30, 30))) - labels[part]
            rows = np.repeat(np.arange(len(part)), np.diff(starts))
            slope = float(error.sum())
            seen_b += slope * slope
            model.bias -= rate * slope / np.sqrt(seen_b)
            used, where = np.unique(ids, return_inverse=True)
            g_w = np.bincount(where, weights=error[rows]).astype(np.float32) + decay * model.weights[used]
            v = model.vectors[ids]
            sums = np.zeros((len(part), FACTORS), np.float32)
            np.add.at(sums, rows, v)
            g_each = error[rows, None] * (sums[rows] - v)
            g_v = np.stack([np.bincount(where, weights=g_each[:, f]) for f in range(FACTORS)], axis=1).astype(np.float32) + decay * model.vectors[used]
            seen_w[used] += g_w * g_w
            seen_v[used] += g_v * g_v
            model.weights[used] -= rate * g_w / np.sqrt(seen_w[used])
            model.vectors[used] -= 0.2 * rate * g_v / np.sqrt(seen_v[used])
    return model


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on at most sample_rows labelled rows that aren't held out, those of least hash of the key.

    Labels other than 0 and 1, null labels and keys labelled both ways are left out; the labels table may
    be empty.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).where(~held_out(key))
    known = known.groupBy(F.col(key).alias("__key")).agg(F.min(label).cast("int").alias("__y"), F.max(label).alias("y_max")).where("__y = y_max")
    chosen = known.orderBy(F.xxhash64("__key"), "__key").limit(sample_rows).select("__key", "__y")
    # Keys may repeat in docs; the bound holds for rows as well.
    texts = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__key"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        terms = Terms()
        for batch in slices(batches):
            yield {"id": batch.column("id"), "y": batch.column("y"), "terms": [np.sort(terms.of(t)).tobytes() for t in batch.column("text").to_pylist()]}

    given = texts.select("id", F.col("__y").alias("y"), "text")
    rows = arrow_map(given, hashed, f"id {given.schema['id'].dataType.simpleString()}, y int, terms binary")
    rows = durable(rows.select("y", "terms", F.xxhash64("id").alias("h"), F.md5("terms").alias("m")))
    sizes = rows.select("h", "m", F.octet_length("terms").alias("n")).orderBy("h", "m").limit(sample_rows).collect()
    most = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), SAMPLE_BYTES, side="right"))
    empty = Machine(0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    if not most:
        return empty
    last = sizes[min(most, len(sizes)) - 1]
    chosen = rows.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("m") <= last["m"])))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        have, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            for part, total in zip(counted([np.frombuffer(t, np.int32) for t in batch.column("terms").to_pylist()], np.array(batch.column("y").to_pylist())), (have, toxic)):
                total += part
        found = np.flatnonzero(have)
        yield {"bucket": found.astype(np.int32), "have": have[found].astype(np.int64), "toxic": toxic[found].astype(np.int64)}

    # One row a bucket. Only what can take part goes on to the driver: most terms tell nothing and are rare.
    sums = arrow_map(chosen.select("y", "terms"), totals, "bucket int, have long, toxic long").groupBy("bucket").agg(F.sum("have").alias("have"), F.sum("toxic").alias("toxic")).toArrow()
    have, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for name, total in (("have", have), ("toxic", toxic)):
        total[sums.column("bucket").to_numpy()] = sums.column(name).to_numpy()
    n, positive = chosen.agg(F.count("*"), F.sum("y")).first()
    wanted = alone(have, toxic, n, positive)
    wanted[usual_ones(have, n)] = True

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            terms = (np.frombuffer(t, np.int32) for t in batch.column("terms").to_pylist())
            yield {"y": batch.column("y"), "terms": [t[wanted[t]].tobytes() for t in terms], "h": batch.column("h"), "m": batch.column("m")}

    found = arrow_map(chosen, thinned, "y int, terms binary, h long, m string").orderBy("h", "m").select("y", "terms").toArrow()
    docs = [np.frombuffer(t, dtype=np.int32) for t in found.column("terms").to_pylist()]
    return fit(docs, found.column("y").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",), below: float | None = None) -> DataFrame:
    """The columns of keep, then score double: 0 to 1, higher is likelier toxic. Null texts count as empty.

    With `below` only rows of a smaller score come out: the others end where they are scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        machine = Machine(*shared.value)
        terms = Terms(machine.weights != 0)
        for batch in slices(batches):
            sets = [terms.of(t) for t in batch.column("__text").to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            found = 1 / (1 + np.exp(-np.clip(machine.logits(np.concatenate(sets), starts), -30, 30)))
            out = {**{c: batch.column(f"__{i}") for i, c in enumerate(keep)}, "score": pa.array(found)}
            if below is not None:
                stays = pa.array(found < below)
                out = {c: v.filter(stays) for c, v in out.items()}
            yield {f"__{i}": v for i, v in enumerate(out.values())}

    given = docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), text_or_empty(text).alias("__text"))
    schema = ", ".join([*(f"__{i} {given.schema[f'__{i}'].dataType.simpleString()}" for i in range(len(keep))), f"__{len(keep)} double"])
    out = arrow_map(given, run, schema)
    return out.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate([*keep, "score"])))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Every row is scored over its whole text, empty and repeated ones too. A null doc_id is not held out and has no
    label. labels may be empty: then all scores are alike. Keys that are labelled both ways, and labels other than 0
    and 1, are left out of the fit. Extra columns, also those of clashing names, are ignored.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

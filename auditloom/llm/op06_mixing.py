"""Mixing sources to target weights.

Words of a source are packed into blocks of fixed length. Each output shard draws how many of its slots
each source gets; slots run through pseudorandom permutations of the source's block indexes, one
permutation an epoch, and blocks are joined by index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import WORD, arrow_map, durable, release, repeated, text_or_empty

#: Words of a block. Totals are met to a block, so small blocks suit small corpora; a large one can do with larger ones.
BLOCK_WORDS = 32
#: Weights by rank of the source, repeating; the share of all words to take; the most repeats of a source.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
#: Slots of an output shard, and the least number of shards.
SHARD_SLOTS = 1 << 20
MIN_SHARDS = 16
#: Shards of a segment: each segment of the output has its exact share of every source, and its shards are drawn given that.
SEGMENT_SHARDS = 512


@dataclass(frozen=True)
class Plan:
    """Of one source: its words, target, blocks and slots; the last slot takes `trim` words at most."""

    source: str | None
    words: int
    target: float
    blocks: int
    slots: int
    trim: int


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Of each source its target: total * share by weight, at most repeats * size, the excess reshared by weight.

    sizes must be in the order of the weights: by code point, null last. Resharing ends when no source is
    above its limit, or when all are at it.
    """
    total = share * sum(n for _, n in sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free and left > 0:
        scale = left / sum(weight[i] for i in free)
        full = [i for i in free if weight[i] * scale > repeats * sizes[i][1]]
        if not full:
            for i in free:
                out[i] = weight[i] * scale
            break
        for i in full:
            out[i] = float(repeats * sizes[i][1])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def plans(sizes: list[tuple[str | None, int]], block: int) -> list[Plan]:
    out = []
    for (source, words), target in zip(sizes, targets(sizes)):
        blocks = -(-words // block)
        whole, rest = divmod(round(target), words) if words else (0, 0)
        slots = whole * blocks + -(-rest // block)
        trim = rest % block or block
        out.append(Plan(source, words, target, blocks, slots, trim))
    return out


def shards_of(slots: list[int]) -> tuple[int, int]:
    """(shards, segments) of an output."""
    shards = max(MIN_SHARDS, -(-sum(slots) // SHARD_SLOTS))
    return shards, -(-shards // SEGMENT_SHARDS)


def span_of(slots: list[int], segment: int) -> tuple[int, int, int]:
    """(first shard, the one after the last, all shards) of a segment."""
    shards, segments = shards_of(slots)
    return shards * segment // segments, shards * (segment + 1) // segments, shards


def shard_counts(slots: list[int], segment: int, seed: int = 5) -> np.ndarray:
    """[shard, source]: multinomial draws of the slots of a segment's shards, given that each source's slots are met in all.

    Of M slots a source has floor(M b / shards) - floor(M a / shards) in the segment of the shards a to b - 1, so that
    draws stay small enough for an exact sampler, whatever the size of the output.
    """
    begin, end, shards = span_of(slots, segment)
    left = np.array([m * end // shards - m * begin // shards for m in slots], dtype=np.int64)
    own = end - begin
    rng, rows = np.random.default_rng([seed, segment]), []
    for s in range(own):
        want, row, rest = int(left.sum()) // (own - s), np.zeros_like(left), int(left.sum())
        # A chain of hypergeometric draws is the multinomial law given the totals.
        for i, n in enumerate(left.tolist()):
            rest -= n
            if want and n:
                row[i] = rng.hypergeometric(n, rest, want)
                want -= int(row[i])
        left -= row
        rows.append(row)
    return np.array(rows).reshape(own, len(slots))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def permuted(at: np.ndarray, n: int, source: int, epoch: int, seed: int = 5) -> np.ndarray:
    """Where a pseudorandom permutation of 0, ..., n - 1 sends the numbers at: a Feistel network, walked until it ends below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng([seed, source, epoch]).integers(0, 1 << 63, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right ^ key) & mask)
        return (left << shift) | right

    out = once(np.asarray(at).astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:  # at most three in four numbers are above, so this ends soon
        out[far] = once(out[far])
    return out.astype(np.int64)


def _positions(rows: DataFrame) -> DataFrame:
    """rows (id, source, size, tie, m) with `off`: the words of the source before the row's first copy.

    Rows are ordered by stretch, then id. There are about as many stretches as a stretch holds rows, so that
    neither a stretch nor the sums of stretches, which alone are ordered across tasks, grow like the rows.
    """
    stretches = max(1, math.isqrt(rows.count()) // 4)
    dealt = rows.withColumn("stretch", F.pmod(F.xxhash64("id", "tie"), F.lit(stretches)).cast("int"))
    words = F.sum(F.col("size") * F.col("m"))
    sums = dealt.groupBy("source", "stretch").agg(words.alias("in_stretch"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "stretch", F.coalesce(F.sum("in_stretch").over(before), F.lit(0)).alias("start")).withColumnsRenamed({"source": "s", "stretch": "t"})
    joined = dealt.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t"))).drop("s", "t")
    within = Window.partitionBy("source", "stretch").orderBy("id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("off", F.col("start") + F.coalesce(words.over(within), F.lit(0))).drop("start", "stretch")


def _slots(spark, found: list[Plan], seed: int, block: int) -> DataFrame:
    """(s, block, takes): of each block that is taken the words that each of its slots takes."""
    slots, sizes, trims = [p.slots for p in found], [p.blocks for p in found], [p.trim for p in found]
    _, segments = shards_of(slots)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for segment in batch.column("id").to_pylist():
                counts = shard_counts(slots, segment, seed)
                begin, _, shards = span_of(slots, segment)
                first = np.array([m * begin // shards for m in slots]) + np.cumsum(counts, axis=0) - counts
                shard, source = np.nonzero(counts)
                yield {"s": source.astype(np.int32), "first": first[shard, source], "n": counts[shard, source]}

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for s, first, n in zip(*(batch.column(c).to_pylist() for c in ("s", "first", "n"))):
                for at in range(first, first + n, 1 << 16):
                    slot = np.arange(at, min(at + (1 << 16), first + n))
                    epoch, place, where = slot // sizes[s], slot % sizes[s], np.empty(len(slot), np.int64)
                    for e in np.unique(epoch).tolist():
                        where[epoch == e] = permuted(place[epoch == e], sizes[s], s, e, seed)
                    yield {"s": np.full(len(slot), s, np.int32), "block": where, "words": np.where(slot == slots[s] - 1, trims[s], block).astype(np.int32)}

    found_in = arrow_map(spark.range(segments, numPartitions=min(segments, 1000)), drawn, "s int, first long, n long")
    dealt = found_in.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a row is one source's slots in one shard
    return arrow_map(dealt, mapped, "s int, block long, words int").groupBy("s", "block").agg(F.sort_array(F.collect_list("words"), asc=False).alias("takes"))


def _pieces(docs: DataFrame, text: str, key: str, source: str, seed: int, block: int) -> tuple[DataFrame, list[Plan]]:
    """(id, source, size, tie, off, source_size, target, block, begin, takes): each row's part of each block and the words of it that each slot takes.

    `off` tells repeated rows apart if they have words.
    """
    spark = docs.sparkSession
    words = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), words.alias("size"), F.xxhash64(text_or_empty(text)).alias("tie"))
    # Equal rows are one with their number, so that no stretch is all of one row.
    rows = durable(rows.groupBy("id", "source", "size", "tie").agg(F.count("*").alias("m")))
    # One row a source; Spark compares strings by their UTF-8 bytes, which is the order of code points.
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    found = plans([(r["source"], r["n"]) for r in sizes], block)
    ranks = spark.createDataFrame([(p.source, i, p.words, p.target) for i, p in enumerate(found)], "source string, s int, source_size long, target double").withColumnRenamed("source", "named")
    placed = _positions(rows).join(F.broadcast(ranks), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    placed = repeated(placed, "m", "nth").withColumn("off", F.col("off") + F.col("nth") * F.col("size")).drop("nth", "m")
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(off div {block}, (off + size - 1) div {block})"))
    parts = placed.select("*", F.explode_outer(spans).alias("block"))
    slots = _slots(spark, found, seed, block) if any(p.slots for p in found) else spark.createDataFrame([], "s int, block long, takes array<int>")
    # Slots are as many as blocks, though they are made from next to nothing: they must not be sent to all tasks.
    parts = parts.join(slots.hint("merge"), ["s", "block"], "left")
    begin = F.greatest(F.col("off") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("off") + F.col("size") - F.col("block") * block, F.lit(block))
    takes = F.transform(F.coalesce("takes", F.array().cast("array<int>")), lambda t: F.greatest(F.least(end, t) - begin, F.lit(0)))
    return parts.select("id", "source", "size", "tie", "off", "source_size", "target", "block", begin.alias("begin"), takes.alias("takes")), found


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 5, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: key, size, source_size, target, taken.

    Null sources are a source of their own, the last. Rows without words are taken zero times. Rows repeated
    with the same key count each for itself, null keys too. Targets are met to less than a block a source, but
    for the short block that may end it. Sources, one row each, are known to the driver. Other columns are
    ignored; an empty table gives an empty result.
    """
    pieces, _ = _pieces(docs, text, key, source, seed, block)
    # `off` tells repeated rows with words apart; those without are counted.
    grouped = pieces.groupBy("id", "source", "size", "off", "tie", "source_size", "target").agg(
        F.coalesce(F.sum(F.aggregate("takes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0).cast("long")).alias("taken"),
        F.when(F.col("size") == 0, F.count("*")).otherwise(1).alias("rows"),
    )
    out = grouped.withColumn("nth", F.explode(F.expr("sequence(1L, rows)")))
    return out.select(F.col("id").alias(key), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 5, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: the columns of docs, a row for each time that words of a row are taken.

    Row k holds the stretches of the text that are taken more than k times, in order and with the white
    space that follows them. n_chars, where there is such a column, is the new length. Rows without words are
    taken zero times; of repeated rows each has its own share, and columns beside key, source and text come from
    any of them.
    """
    pieces, _ = _pieces(docs, text, key, source, seed, block)
    numbered = pieces.where(F.size("takes") > 0).select("id", "source", "size", "tie", "off", F.posexplode("takes").alias("k", "n"), (F.col("block") * block + F.col("begin") - F.col("off")).alias("at")).where("n > 0")
    chosen = numbered.groupBy("id", "source", "size", "tie", "off", "k").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("parts"))
    chosen = durable(chosen.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), "parts"))
    release(docs.sparkSession)
    same = F.col(key).eqNullSafe(F.col("__id")) & F.col(source).eqNullSafe(F.col("__source")) & (F.col("__tie2") == F.col("__tie"))
    marked = docs.withColumn("__tie2", F.xxhash64(text_or_empty(text)))
    several = durable(marked.groupBy(F.col(key).alias("__i"), F.col(source).alias("__s"), F.col("__tie2").alias("__t")).count().where("count > 1").drop("count"))
    if several.isEmpty():
        joined = marked.join(chosen, same)
    else:
        # Of repeated rows one is joined with the shares of all.
        again = F.col(key).eqNullSafe(F.col("__i")) & F.col(source).eqNullSafe(F.col("__s")) & (F.col("__tie2") == F.col("__t"))
        once = marked.join(several, again, "left_semi").dropDuplicates([key, source, "__tie2"])
        joined = marked.join(several, again, "left_anti").unionByName(once).join(chosen, same)
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        word = re.compile(WORD)
        for batch in batches:
            texts = []
            for value, parts in zip(batch.column(text).to_pylist(), batch.column("parts").to_pylist()):
                begins = [m.start() for m in word.finditer(value)] + [len(value)]
                texts.append("".join(value[begins[p["at"]] : begins[p["at"] + p["n"]]] for p in parts))
            out = {c: batch.column(c) for c in columns} | {text: pa.array(texts, pa.string())}
            if "n_chars" in columns:
                out["n_chars"] = pa.array(list(map(len, texts)), batch.column("n_chars").type)
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(joined.select(*columns, "parts"), cut, schema)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

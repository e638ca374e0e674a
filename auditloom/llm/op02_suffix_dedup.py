"""Removal of repeated byte strings by suffix sorting.

A suffix array over every byte would be dozens of times the size of the text. But of two equal strings of
LENGTH bytes the same positions are least by hash in windows of WINDOW bytes, so suffixes at such anchors
tell which strings can be repeated at all:

1. Suffixes at anchors go by their leading tokens to range partitions between sampled splitters. Each
   partition sorts its own by multikey quicksort and compares neighbours, across the partition's ends too.
   The anchor's span (all strings of which it is the anchor) is then repeated as a whole, or alone for
   certain, or in doubt.
2. Only in spans in doubt every position's own suffix is sorted and compared in the same way.

Tokens of a suffix are its leading bytes, so that partitions and their rows are in the order of suffixes, and
fingerprints of longer beginnings, 128 bits in all for the strings that are compared: equal tokens mean equal
strings without the strings being carried along. Before either sort, a filter of fingerprints that occur more
than once holds back suffixes that are alone for certain. Whole copies of a document are settled before, by
their digests, and take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm import bloom
from auditloom.llm.common import arrow_map, durable, join_group_facts, release, shuffle_partitions, small_or_shuffled, text_or_empty

LENGTH = 400
WINDOW = 128
#: Bytes that an anchor's hash looks at, and the beginning that all strings of an anchor share.
GRAM = 8
SHARED = LENGTH - WINDOW + 1
#: Texts are worked on in heaps of about so many bytes.
HEAP = 1 << 19
#: Rows that one task sorts; parts of at most so many are sorted directly.
SORT_ROWS = 500_000
SMALL = 8192
#: Documents, and bytes of their spans, up to which they are sent to all tasks of the scan.
FEW, FEW_BYTES = 200_000, 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_SIGN = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Heap:
    """Some texts end to end, with fingerprints of any of their strings of at least GRAM bytes."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, texts: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.total = int(self.sizes.sum())
        raw = np.frombuffer(b"".join([*texts, b"\0" * GRAM]), np.uint8)
        grams = np.lib.stride_tricks.sliding_window_view(raw, GRAM)[: self.total]
        self.lead = np.ascontiguousarray(grams).view(">u8").ravel().astype(np.uint64)
        self.mixed = _mix(self.lead)
        cls = Heap
        if len(cls.powers) <= self.total:
            n = 1 << self.total.bit_length()
            cls.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
            cls.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)

    @classmethod
    def forget(cls) -> None:
        cls.powers, cls.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.uint64(0)], np.cumsum(values * Heap.powers[: self.total], dtype=np.uint64)])

    @cached_property
    def one(self) -> np.ndarray:
        return self._sums(self.mixed)

    @cached_property
    def two(self) -> np.ndarray:
        return self._sums(_mix(self.lead ^ _OTHER))

    def leading(self, at: np.ndarray) -> np.ndarray:
        """The GRAM bytes from each position on, as integers in the order of bytes."""
        return (self.lead[at] ^ _SIGN).view(np.int64)

    def fingerprint(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the strings [begin, end), from their runs of grams; sums are `one` or `two`, which are independent."""
        raw = (sums[end - GRAM + 1] - sums[begin]) * Heap.inverses[begin]
        return _mix(raw ^ (end - begin).astype(np.uint64) * _BASE).view(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, anchor, low, high): the positions low..high are those whose string has this anchor."""
        if self.total < LENGTH:
            return (np.zeros(0, np.int64),) * 4
        # The least hash of each window, the leftmost on ties, by doubling.
        least = (self.mixed & ~np.uint64(0xFFFFFFFF)) | np.arange(self.total, dtype=np.uint64)
        width = 1
        while width < WINDOW:
            np.minimum(least[:-width], least[width:], out=least[:-width])
            width *= 2
        whole = np.zeros(self.total + 1, np.int8)  # positions at which a string fits into its text
        fits = self.sizes >= LENGTH
        whole[self.begins[fits]] += 1
        whole[self.ends[fits] - LENGTH + 1] -= 1
        at = np.flatnonzero(np.cumsum(whole[:-1]))
        anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(at) else first
        low, high = at[first], at[last]
        return np.searchsorted(self.ends, low, side="right"), anchor[first], low, high


def _heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Heap]]:
    """Rows whose `body` sums up to about HEAP bytes, or single ones, with their heap."""
    try:
        for batch in batches:
            size, start = 0, 0
            for k, n in enumerate(pc.binary_length(batch.column("body")).to_pylist()):
                size += n
                if size >= HEAP or k + 1 == batch.num_rows:
                    some = batch.slice(start, k + 1 - start)
                    yield some, Heap(some.column("body").to_pylist())
                    size, start = 0, k + 1
    finally:
        Heap.forget()


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by tokens, by multikey quicksort: in three parts around a pivot of the first token, of which
    the equal ones go on with the next token."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(tokens):
            continue
        part = order[low:high]
        if high - low <= SMALL:
            order[low:high] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        value = tokens[depth][part]
        pivot = np.sort(value[:: max(1, len(value) // 31)])[-1 - len(value[:: max(1, len(value) // 31)]) // 2]
        less, more = value < pivot, value > pivot
        parts = part[less], part[~(less | more)], part[more]
        order[low:high] = np.concatenate(parts)
        at = np.cumsum([low, *map(len, parts)])
        todo += [(at[0], at[1], depth), (at[1], at[2], depth + 1), (at[2], at[3], depth)]
    return order


#: Where a row stands in its partition: in the first or last run, among the first or last equals.
_FIRST_RUN, _LAST_RUN, _FIRST_EQUAL, _LAST_EQUAL = 1, 2, 4, 8


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the one before in any of the sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _compared(records: DataFrame, tokens: list[str], run: int, keep: list[str]) -> DataFrame:
    """The columns of keep, for rows that are repeated or in doubt: `again` (equal to another in all tokens), `first`
    (the first of its equals in the partition) and `mixed` (rows that agree in the first `run` tokens don't in all).

    records must be durable: splitters are sampled from it. The salt lets them fall into a row of equal suffixes,
    so that no such row need fit into one task. Partitions are sorted and compared where they are; what they tell of
    their ends, a few numbers each, is compared by the driver.
    """
    spark = records.sparkSession
    salted = records.withColumn("salt", F.xxhash64(*records.columns))
    parts = max(shuffle_partitions(spark), -(-records.count() // SORT_ROWS))
    ranged = salted.repartitionByRange(parts, *tokens, "salt").drop("salt")
    types = dict(records.dtypes)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        columns = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in some]) for n in {*tokens, *keep}}
        del some
        order = multikey_order([columns[t] for t in tokens])
        keys = [columns[t][order] for t in tokens]
        n, part = len(order), TaskContext.get().partitionId()
        equal, runs = _starts(keys), _starts(keys[:run])
        sizes, lengths = np.diff(np.append(equal, n)), np.diff(np.append(runs, n))
        again = np.repeat(sizes > 1, sizes)
        first = np.zeros(n, bool)
        first[equal] = True
        last = runs + lengths - 1
        mixed = np.repeat(np.logical_or.reduce([k[runs] != k[last] for k in keys[run:]]), lengths)
        place = np.zeros(n, np.int32)
        place[: lengths[0]] |= _FIRST_RUN
        place[runs[-1] :] |= _LAST_RUN
        place[: sizes[0]] |= _FIRST_EQUAL
        place[equal[-1] :] |= _LAST_EQUAL
        told = np.flatnonzero(again | mixed | (place > 0))
        ends = [[int(k[i]) for i in (0, n - 1, runs[-1], lengths[0] - 1) for k in keys]]
        zero = {c: np.zeros(1, np.int64) for c in keep}
        yield {**zero, "part": [part], "again": [False], "first": [False], "mixed": [False], "place": [0], "ends": ends}
        for at in range(0, len(told), 10_000):
            rows = told[at : at + 10_000]
            yield {**{c: columns[c][order[rows]] for c in keep}, "part": np.full(len(rows), part), "again": again[rows], "first": first[rows], "mixed": mixed[rows], "place": place[rows], "ends": [None] * len(rows)}

    named = {"bigint": "long", "int": "int"}
    schema = ", ".join([*(f"{c} {named[types[c]]}" for c in keep), "part int", "again boolean", "first boolean", "mixed boolean", "place int", "ends array<long>"])
    judged = durable(arrow_map(ranged, sort, schema))
    # One row a partition, whatever the input.
    k = len(tokens)
    told = sorted((r["part"], *(tuple(r["ends"][i : i + k]) for i in range(0, 4 * k, k))) for r in judged.where("ends is not null").select("part", "ends").collect())
    rows = []
    for i, (part, low, high, last_low, first_high) in enumerate(told):
        # Runs at the ends go on in as many partitions as they fill.
        least, most, before, after = low, high, i - 1, i + 1
        while before >= 0 and told[before][2][:run] == low[:run]:
            least, before = told[before][3], before - 1 if told[before][1][:run] == low[:run] else -1
        while after < len(told) and told[after][1][:run] == high[:run]:
            most, after = told[after][4], after + 1 if told[after][2][:run] == high[:run] else len(told)
        whole = low[:run] == high[:run] and least != most
        rows.append((part, i > 0 and told[i - 1][2] == low, i + 1 < len(told) and told[i + 1][1] == high, whole or least != first_high, whole or last_low != most))
    ends = spark.createDataFrame(rows, "part int, a1 boolean, a2 boolean, m1 boolean, m2 boolean")
    found = judged.where("ends is null").join(F.broadcast(ends), "part")
    at = lambda flag, told: (F.col("place").bitwiseAND(flag) > 0) & F.col(told)
    found = found.withColumn("again", F.col("again") | at(_FIRST_EQUAL, "a1") | at(_LAST_EQUAL, "a2"))
    found = found.withColumn("mixed", F.col("mixed") | at(_FIRST_RUN, "m1") | at(_LAST_RUN, "m2"))
    return found.where("again or mixed").select(*keep, "again", "first", "mixed")


NAME = ["u0", "u1"]


def _name(sha: Column) -> list[Column]:
    """128 bits of a binary digest as two integers."""
    return [F.conv(F.hex(F.substring(sha, i, 8)), 16, -10).cast("long").alias(n) for n, i in zip(NAME, (1, 9))]


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs joined with their spans; these go to the scan if they are few, so that no text is shuffled."""
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("spans")), F.lit(0))).first()
    return docs.join(F.broadcast(spans) if n <= FEW and size <= FEW_BYTES else spans, NAME)


def _spans_of(rows: DataFrame) -> DataFrame:
    """(u0, u1, spans) of (u0, u1, low, high, bits): the positions of a document as few runs, each as two 32-bit integers.

    A row holds the positions low to high, or, where high is -1, those of the 64 from low on whose bit is set.
    """
    listed = rows.groupBy(*NAME).agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"), F.collect_list("bits").alias("bits"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "bits"))):
                low, high, bits = (np.array(x, dtype=np.int64) for x in row)
                piece, bit = np.nonzero((bits[high < 0, None] >> np.arange(64)) & 1)
                single = low[high < 0][piece] + bit
                spans = np.stack([np.concatenate([low[high >= 0], single]), np.concatenate([high[high >= 0], single])], axis=1)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                ends = np.maximum.accumulate(spans[:, 1])
                first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > ends[:-1] + 1]))
                out.append(np.stack([spans[first, 0], ends[np.append(first[1:], len(ends)) - 1]], axis=1).astype("<i4").tobytes())
            yield {"u0": batch.column("u0"), "u1": batch.column("u1"), "spans": out}

    return arrow_map(listed, merged, "u0 long, u1 long, spans binary")


def _unpacked(spans: bytes) -> np.ndarray:
    """[low, high] of packed runs, in order."""
    return np.frombuffer(spans, "<i4").astype(np.int64).reshape(-1, 2)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(u0, u1, low, high, bits): positions (see _spans_of) of docs (u0, u1, body binary) at which strings of LENGTH bytes begin that begin elsewhere too.

    Texts are known by u0 and u1; a text that comes several times may be told more than once.
    """
    spark = docs.sparkSession

    def anchors(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[dict]:
        for some, heap in _heaps(batches):
            text, anchor, low, high = heap.spans()
            shared = heap.fingerprint(heap.one, anchor, anchor + SHARED)
            if not whole:
                yield {"shared": shared}
                continue
            stays = np.flatnonzero(bloom.among(shared, filled.value))
            text, anchor, low, high = text[stays], anchor[stays], low[stays], high[stays]
            start = heap.begins[text]
            u0, u1 = _longs(some, *NAME)
            yield {
                "lead": heap.leading(anchor), "lead2": heap.leading(anchor + GRAM), "shared": shared[stays],
                "whole": heap.fingerprint(heap.one, low, high + LENGTH), "deep": heap.fingerprint(heap.two, low, high + LENGTH),
                "u0": u0[text], "u1": u1[text], "low": (low - start).astype(np.int32), "high": (high - start).astype(np.int32),
            }

    # A beginning that occurs once ends the matter; most do, and only the others are sorted.
    size = docs.agg(F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0)).alias("n")).first()["n"]
    filled = spark.sparkContext.broadcast(bloom.build(arrow_map(docs, lambda b: anchors(b, False), "shared long"), "shared", bloom.size_for(size // (WINDOW // 2)), times=2))
    schema = "lead long, lead2 long, shared long, whole long, deep long, u0 long, u1 long, low int, high int"
    records = durable(arrow_map(docs, lambda b: anchors(b, True), schema))
    filled.destroy()
    judged = durable(_compared(records, ["lead", "lead2", "shared", "whole", "deep"], 3, [*NAME, "low", "high"]))
    del records
    release(spark)
    none = F.lit(0).cast("long").alias("bits")
    settled = judged.where("again").select(*NAME, "low", "high", none)
    doubtful = durable(_spans_of(judged.where("mixed and (not again or first)").select(*NAME, "low", "high", none).distinct()))
    texts = _with_spans(docs, doubtful)

    def positions(batches: Iterator[pa.RecordBatch], chosen: bool) -> Iterator[dict]:
        for some, heap in _heaps(batches):
            u0, u1 = _longs(some, *NAME)
            for doc, spans in enumerate(map(_unpacked, some.column("spans").to_pylist())):
                lengths = spans[:, 1] - spans[:, 0] + 1
                at = np.repeat(spans[:, 0] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                p = at + heap.begins[doc]
                whole = heap.fingerprint(heap.one, p, p + LENGTH)
                if not chosen:
                    yield {"whole": whole}
                    continue
                stays = np.flatnonzero(bloom.among(whole, repeats.value))
                p = p[stays]
                yield {"lead": heap.leading(p), "whole": whole[stays], "deep": heap.fingerprint(heap.two, p, p + LENGTH), "u0": np.full(len(p), u0[doc]), "u1": np.full(len(p), u1[doc]), "low": at[stays].astype(np.int32)}

    size = judged.where("mixed and (not again or first)").agg(F.coalesce(F.sum(F.col("high") - F.col("low") + 1), F.lit(0))).first()[0]
    repeats = spark.sparkContext.broadcast(bloom.build(arrow_map(texts, lambda b: positions(b, False), "whole long"), "whole", bloom.size_for(size), times=2))
    single = durable(arrow_map(texts, lambda b: positions(b, True), "lead long, whole long, deep long, u0 long, u1 long, low int"))
    repeats.destroy()
    found = _compared(single, ["lead", "whole", "deep"], 1, [*NAME, "low"]).where("again")
    # Neighbouring positions travel together: one row for those that lie in the same 64.
    bits = found.groupBy(*NAME, F.floor(F.col("low") / 64).cast("int").alias("piece")).agg(F.bit_or(F.expr("shiftleft(1L, low % 64)")).alias("bits"))
    return settled.unionByName(bits.select(*NAME, (F.col("piece") * 64).alias("low"), F.lit(-1).alias("high"), "bits"))


def _cut(body: bytes, spans: np.ndarray) -> tuple[int, bytes]:
    """(removed runs, what is left) when the strings that begin in the spans, which are in order, are removed."""
    ends = spans[:, 1] + LENGTH
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > ends[:-1]]))
    lows, highs = spans[new, 0].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist()
    return len(new), b"".join(body[a:b] for a, b in zip([0, *highs], [*lows, len(body)]))


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256[, kept binary].

    Removed is each byte of a LENGTH-byte string that begins anywhere else as well, in the same text or in
    another; strings are judged on the input and never cross texts. Null counts as empty, and texts shorter
    than LENGTH stay whole. Keys may have any ordered type, be null or repeat: each row is a text of its own.
    Other columns are ignored; an empty table gives an empty result.
    """
    given = docs.select(F.col(key).alias("id"), text_or_empty(text).cast("binary").alias("body"))
    narrow = durable(given.select("id", F.octet_length("body").cast("long").alias("n_bytes"), F.unhex(F.sha2("body", 256)).alias("sha")))
    classes = durable(narrow.groupBy("sha", "n_bytes").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("*", *_name(F.col("sha"))))
    long_ones = given.where(F.octet_length("body") >= LENGTH).select("body", "id", *_name(F.unhex(F.sha2("body", 256))))
    # Of whole copies one goes on; texts aren't shuffled for that unless very many are copied.
    copied = small_or_shuffled(durable(classes.where((F.col("n_bytes") >= LENGTH) & (F.col("copies") > 1)).select(*NAME, "rep", F.lit(True).alias("many"))))
    own = long_ones.join(copied, NAME, "left").where(F.col("many").isNull() | F.col("id").eqNullSafe(F.col("rep"))).select(*NAME, "body")
    spans = durable(_spans_of(repeated_spans(own)))
    release(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            done = [_cut(body, _unpacked(spans)) for body, spans in zip(bodies, batch.column("spans").to_pylist())]
            out = {"u0": batch.column("u0"), "u1": batch.column("u1"), "n_removed": [len(b) - len(left) for b, (_, left) in zip(bodies, done)], "n_spans": [n for n, _ in done]}
            yield {**out, "kept_sha": [hashlib.sha256(left).digest() for _, left in done], "left": [left if with_text else None for _, left in done]}

    schema = "u0 long, u1 long, n_removed long, n_spans long, kept_sha binary, left binary"
    removed = arrow_map(_with_spans(own, spans), cut, schema).dropDuplicates(NAME)
    facts = classes.join(removed, NAME, "left")
    all_of_it = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero, empty = F.lit(0).cast("long"), F.lit("").cast("binary")
    facts = facts.select(
        "sha", "n_bytes", "copies",
        F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_of_it, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.lower(F.when(all_of_it, F.sha2(empty, 256)).otherwise(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        F.when(all_of_it, empty).otherwise(F.col("left")).alias("left"),
    )
    out = join_group_facts(narrow, facts if with_text else facts.drop("left"), ["sha", "n_bytes"], "copies")
    out = out.select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["left", "sha"] if with_text else []))
    if not with_text:
        return out
    bodies = given.select(F.col("id").alias("id_"), "body", F.unhex(F.sha2("body", 256)).alias("sha_")).dropDuplicates(["id_", "sha_"])
    joined = out.join(bodies, F.col(key).eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")))
    return joined.select(key, "n_bytes", "n_removed", "n_spans", "kept_sha256", F.when(F.col("n_removed") > 0, F.col("left")).otherwise(F.col("body")).alias("kept"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

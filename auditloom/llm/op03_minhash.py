"""Near-duplicate documents by circulant MinHash, banding and exact verification.

One permutation scatters the shingles over the universe, a second one, circularly shifted by 0, 1, 2, ...,
gives all coordinates of a signature. Bands of coordinates propose partners, which full sets confirm.

Groups are never expanded into all their pairs. Documents of equal sets form a class, and the graph joins
classes by number. Every member of a bucket is compared with the bucket's least one; what these links connect
needs no further comparison. Only in buckets that still hold several components the rest is compared across
components, inside blocks of bounded rows and bytes, and only links leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import bloom
from auditloom.llm.common import arrow_map, durable, join_group_facts, release, slices, small_or_shuffled, text_or_empty
from auditloom.llm.components import components

WORDS = 5
#: Bands of ROWS coordinates: at a similarity of 0.75 all bands miss with a probability of 5e-6.
BANDS, ROWS = 32, 4
#: Share of equal coordinates below which a pair isn't worth its full sets: at 0.75 the risk is 2e-6.
LIKELY = 0.57
#: A block holds about so many documents and bytes of sets at most, or one document.
BLOCK, BLOCK_BYTES = 256, 2 << 20
#: Words that a worker remembers; it forgets them when it is full, and after each task.
_WORDS_KNOWN = 60_000
#: Rows of the table of wanted classes up to which it is sent to all tasks of the scan.
WANTED_ROWS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The set of a text: sorted distinct 64-bit hashes of its shingles."""

    FACTORS = _mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # A-Z only, and at exactly the contract's white space
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _WORDS_KNOWN:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(WORDS, len(words))  # fewer words than a shingle has: the whole sequence
        sums = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            sums += hashes[i : len(words) - n + 1 + i] * self.FACTORS[i]
        return np.unique(_mix(sums))


def name_of(shingles: np.ndarray) -> tuple[int, int, int]:
    """A set's size and two independent 64-bit sums over it: sets of one name are taken as equal."""
    one = int(np.add.reduce(_mix(shingles + np.uint64(1))).view(np.int64))
    two = int(np.bitwise_xor.reduce(_mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64))
    return len(shingles), one, two


class Circulant:
    """Signatures of BANDS * ROWS coordinates from two permutations of a universe of 2^32.

    The second one is computed, not tabulated, and the universe is so large that unrelated sets of a million
    shingles agree in one of ten thousand coordinates only.
    """

    PART = 512

    def __init__(self, seed: int = 11) -> None:
        width = BANDS * ROWS
        self.seed = _mix(np.array([seed], dtype=np.uint64))[0]
        self.shifts = np.arange(width, dtype=np.uint32)
        self.lanes = _mix(np.arange(width, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
        self.names = _mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1000 + seed))
        self.x, self.t = (np.empty((self.PART, width), np.uint32) for _ in range(2))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = (_mix(shingles ^ self.seed) >> np.uint64(32)).astype(np.uint32)  # the first permutation, folded to the universe
        out = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for part in range(0, len(at), self.PART):
            some = at[part : part + self.PART, None]
            x, t = self.x[: len(some)], self.t[: len(some)]
            np.add(some, self.shifts, out=x)  # around the end of the universe
            # The second permutation: shifts and odd factors are bijections of 32-bit numbers.
            for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97), (15, 1)):
                np.right_shift(x, shift, out=t)
                np.bitwise_xor(x, t, out=x)
                if factor > 1:
                    np.multiply(x, np.uint32(factor), out=x)
            np.minimum(out, x.min(axis=0), out=out)
        return out

    def bands(self, signature: np.ndarray) -> np.ndarray:
        lanes = (signature.astype(np.uint64) + np.uint64(1)) * self.lanes
        return _mix(lanes.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) ^ self.names).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    shingler, circulant = Shingler(), Circulant()
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            shingles = shingler.of(text)
            if not len(shingles):
                rows.append((0, 0, 0, None, None))
                continue
            signature = circulant.signature(shingles)
            rows.append((*name_of(shingles), circulant.bands(signature), (signature & 0xFF).astype(np.uint8).tobytes()))
        yield {"id": batch.column("id"), "h": batch.column("h"), **dict(zip(("n", "one", "two", "bands", "sig"), map(list, zip(*rows))))}


def _full_sets(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, set) of the wanted classes, from the texts that stand for them; the others leave at the scan."""
    few = wanted.select("c", "n", "one", "two", F.col("rep.id").alias("rep_id"), F.col("rep.h").alias("rep_h"))
    found = given.join(small_or_shuffled(durable(few), WANTED_ROWS), (F.col("h") == F.col("rep_h")) & F.col("id").eqNullSafe(F.col("rep_id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shingler, seen = Shingler(), set()
        for batch in slices(batches):
            rows = []
            for text, c, *name in zip(*(batch.column(k).to_pylist() for k in ("text", "c", "n", "one", "two"))):
                # Repeated rows stand for one class; a text of the same hash may be another one's.
                if c not in seen and name_of(shingles := shingler.of(text)) == tuple(name):
                    seen.add(c)
                    rows.append((c, shingles.tobytes()))
            yield {"c": [c for c, _ in rows], "set": [s for _, s in rows]}

    return arrow_map(found.select("text", "c", "n", "one", "two"), sets, "c long, set binary")


def _likely_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of pairs with signatures those that agree in a share of LIKELY of the coordinates."""
    width = BANDS * ROWS
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("sig_a", "sig_b"))
        stays = pa.array((x == y).mean(axis=1) >= LIKELY)
        yield {c: batch.column(c).filter(stays) for c in ("a", "b")}


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) the links: 100 * intersection >= percent * union, on full sets."""
    sigs = classes.select("c", "sig")
    joined = pairs.join(sigs.withColumnsRenamed({"c": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"c": "b", "sig": "sig_b"}), "b")
    likely = durable(arrow_map(joined, _likely_pairs, "a long, b long"))
    both = likely.join(sets.withColumnsRenamed({"c": "a", "set": "set_a"}), "a").join(sets.withColumnsRenamed({"c": "b", "set": "set_b"}), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            rows = []
            for a, b, *raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b"))):
                x, y = (np.frombuffer(r, np.uint64) for r in raw)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    rows.append((a, b))
            yield {"a": [a for a, _ in rows], "b": [b for _, b in rows]}

    return durable(arrow_map(both, linked, "a long, b long").distinct())


def _links_in(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join components, among rows (c, label, n, sig, bands, set, side) that share a band; full sets decide."""
    ids, n = pdf["c"].to_numpy(), pdf["n"].to_numpy()
    label = np.unique(pdf["label"].to_numpy(), return_inverse=True)[1]
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    bands = np.stack(pdf["bands"].to_numpy())
    sets = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
    side = pdf["side"].to_numpy()
    across, found = side.any(), []  # two blocks are compared with each other only
    for i in range(len(pdf) - 1):
        rest = np.arange(i + 1, len(pdf))
        rest = rest[side[rest] != side[i]] if across else rest
        rest = rest[(label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
        rest = rest[(bands[rest] == bands[i]).any(axis=1)]
        rest = rest[(sig[rest] == sig[i]).mean(axis=1) >= LIKELY]
        if not len(rest):
            continue
        own = sets[i]
        lengths = np.array([len(sets[j]) for j in rest])
        every = np.concatenate([sets[j] for j in rest])
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        common = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(lengths) - lengths)
        for j in rest[100 * common >= percent * (lengths + len(own) - common)]:
            if label[j] != label[i]:
                found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                label[label == label[j]] = label[i]
    return found


def _mostly_shared(members: DataFrame, sets: DataFrame, percent: int, bits: int | None = None) -> DataFrame:
    """Of members the rows whose documents have at least percent of their shingles in others of them as well.

    A link needs that many in one partner alone, so none is lost; what shares only a passage drops out here. Shared
    shingles are told by a filter that goes to all tasks as long as its bound holds them, else they are counted in
    a shuffle.
    """
    bits = bits or bloom.MAX_BITS
    own = members.select("c", "n").distinct()
    full = durable(own.join(sets, "c"))
    size = full.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            some = batch.column("set").to_pylist()
            yield {"c": np.repeat(np.array(batch.column("c").to_pylist(), np.int64), [len(s) // 8 for s in some]), "token": np.frombuffer(b"".join(some), np.int64)}

    every = arrow_map(full.select("c", "set"), tokens, "c long, token long")
    if size * bloom.BITS_A_ROW <= bits:
        again = full.sparkSession.sparkContext.broadcast(bloom.build(every, "token", bloom.size_for(size), times=2))

        def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in slices(batches):
                rows = [np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist()]
                stays = pa.array([100 * int(bloom.among(x, again.value).sum()) >= percent * len(x) for x in rows], pa.bool_())
                yield {"c": batch.column("c").filter(stays)}

        kept = durable(arrow_map(full.select("c", "set"), enough, "c long"))
        again.destroy()
    else:
        repeated = every.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token")
        shared = every.join(repeated, "token", "left_semi").groupBy("c").agg(F.count("*").alias("shared"))
        kept = shared.join(own, "c").where(F.expr(f"100 * shared >= {percent} * n")).select("c")
    return members.join(kept, "c", "left_semi")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Of (bucket, c, n, label) the rows of buckets that hold several labels."""
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket")
    return durable(labelled.join(mixed, "bucket"))


def _across(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of the same bucket, as few as join them.

    members: (bucket, c, n, label) of buckets that hold several labels. A document is at home in its largest
    bucket, homes are cut into blocks, and two blocks are compared if a bucket reaches into both. So no pair
    is emitted before it is verified, and a full set goes once to each pair of blocks, not to each partner.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n_in"))
    dealt = durable(join_group_facts(members, sizes, ["bucket"], "n_in"))
    at_home = dealt.groupBy("c", "n", "label").agg(F.max(F.struct("n_in", "bucket")).alias("top")).select("c", "n", "label", F.col("top.bucket").alias("top"))
    counts = at_home.groupBy("top").agg(F.count("*").alias("n_home"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks"))
    at_home = join_group_facts(at_home, counts, ["top"], "n_home")
    at_home = durable(at_home.select("c", "n", "label", F.struct("top", F.pmod(F.xxhash64("c"), F.col("blocks")).alias("block")).alias("home")))
    reach = durable(dealt.select("bucket", "c").join(at_home.select("c", "home"), "c").select("bucket", "home").distinct())
    blocks = reach.join(reach.withColumnRenamed("home", "home2"), "bucket").where("home <= home2").select(F.col("home").alias("h1"), F.col("home2").alias("h2")).distinct()
    blocks = durable(blocks)
    both = blocks.select("h1", "h2", F.col("h1").alias("home")).unionByName(blocks.where("h1 <> h2").select("h1", "h2", F.col("h2").alias("home")))
    cards = at_home.join(classes.select("c", "sig", "bands"), "c").join(sets, "c")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_links_in(pdf, percent) if pdf["label"].nunique() > 1 else [], columns=["a", "b"], dtype="int64")

    grouped = cards.join(both, "home").select("h1", "h2", "c", "label", "n", "sig", "bands", "set", ((F.col("h1") != F.col("h2")) & (F.col("home") == F.col("h2"))).alias("side")).groupBy("h1", "h2")
    return durable(grouped.applyInPandas(compare, "a long, b long").distinct())


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 75) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Rows are linked when their sets of WORDS-word shingles overlap by at least percent of the union.
    Without words (null and empty texts, white space) a row has the empty set and links with nothing: its
    component is its own key. Keys may have any ordered type, be null or repeat: links join texts, and a
    component is named by its least key, which is null only if none of its rows has one. Other columns are
    ignored, and an empty table gives an empty result.
    """
    given = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = given.schema["id"].dataType.simpleString()
    rows = durable(arrow_map(given, _sketch, f"id {kind}, h long, n long, one long, two long, bands array<long>, sig binary"))
    same = ["n", "one", "two"]
    # A class is known by a number, which lasts as the table is written before anything reads it.
    classes = rows.where("n > 0").groupBy(*same).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = durable(classes.withColumn("c", F.monotonically_increasing_id()))
    rows = rows.select("id", *same)
    release(docs.sparkSession)
    # The size of a set goes along with its number: pairs of unlike sizes can't be linked.
    in_bucket = classes.select("c", "n", F.explode("bands").alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.min("c").alias("lo"), F.min_by("n", "c").alias("lo_n"), F.max("c").alias("hi")).where("lo < hi").drop("hi")
    members = durable(in_bucket.join(shared, "bucket"))
    sets = durable(_full_sets(given, classes.join(members.select("c").distinct(), "c", "left_semi")))
    release(docs.sparkSession)
    star = members.where(F.expr(f"c <> lo and 100 * least(n, lo_n) >= {percent} * greatest(n, lo_n)"))
    links = _verified(star.select(F.col("lo").alias("a"), F.col("c").alias("b")).distinct(), classes, sets, percent)
    release(docs.sparkSession)
    found = components(links)
    labelled = durable(members.select("bucket", "c", "n").join(found.withColumnRenamed("id", "c"), "c", "left").select("bucket", "c", "n", F.coalesce("component", "c").alias("label")))
    del members, star, shared, in_bucket
    mixed = _mixed(_mostly_shared(_mixed(labelled), sets, percent))
    del labelled
    release(docs.sparkSession)
    more = _across(mixed, classes, sets, percent)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    del mixed, more, sets, links
    release(docs.sparkSession)
    facts = classes.select("c", *same, F.col("rep.id").alias("rep"), "copies").join(found.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    facts = durable(facts)
    least = facts.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_in"))
    facts = durable(join_group_facts(facts, least, ["component"], "n_in").select(*same, "copies", "component_id"))
    release(docs.sparkSession)
    linked = join_group_facts(rows.where("n > 0"), facts, same, "copies").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

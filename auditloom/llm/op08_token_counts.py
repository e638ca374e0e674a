"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits reach.

Pre-tokens are matched from left to right, and a match depends on what follows it only. So after an edit
matching starts again at the block of pre-tokens that holds a few characters before it, and stops at the first
block beyond the edit that begins where one began before: from there on all pre-tokens are as they were.

Trees are rows of a table: `chars` and `tokens` hold a segment tree over blocks of pre-tokens as a heap (sums at
1, children of i at 2i and 2i + 1). Edits, also rows of a table, are applied to it and give the next one, so that
a count is never taken again from the whole text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import arrow_map, shared_dir, slices, text_or_empty
from auditloom.llm.op07_byte_bpe import Codec, codec, distribute

#: Pre-tokens of a block when it is made, and how many times that a block may hold before blocks are made anew.
BLOCK = 16
FULL = 4
#: Characters before an edit from which matching starts: contractions look ahead by two characters.
CONTEXT = 4

EDITS = "array<struct<at:bigint,deleted:bigint,inserted:string>>"


class CountTree:
    """The token count of one text under edits; chars and tokens are int32 arrays."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.text, self.chars, self.tokens, self.width = text, chars, tokens, len(chars) // 2
        self.encoded = 0

    @classmethod
    def build(cls, texts: list[str], coder: Codec) -> Iterator[CountTree]:
        """The trees of texts, whose new pre-tokens are encoded together."""
        at = iter(texts)
        for split in coder.split(texts):
            coder.measure(set(chain.from_iterable(split)))
            for pieces in split:
                tree = cls(next(at), np.zeros(2, np.int32), np.zeros(2, np.int32))
                tree._grow(*tree._blocks(pieces, coder))
                yield tree

    def _blocks(self, pieces: list[str], coder: Codec) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of blocks of fresh pre-tokens."""
        n = len(pieces)
        self.encoded += n
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        starts = np.arange(0, n, BLOCK)
        return tuple(np.add.reduceat(np.fromiter(x, np.int32, count=n), starts) for x in (map(len, pieces), coder.counts(pieces)))

    def _grow(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        for name, leaves in (("chars", chars), ("tokens", tokens)):
            out = np.zeros(2 * self.width, np.int32)
            out[self.width : self.width + len(leaves)] = leaves
            level = self.width
            while level > 1:
                out[level // 2 : level] = out[level : 2 * level : 2] + out[level + 1 : 2 * level : 2]
                level //= 2
            setattr(self, name, out)

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    def _find(self, position: int) -> tuple[int, int]:
        """(block, its begin): the block that holds the position, or the last one."""
        node, begin, chars = 1, 0, self.chars
        while node < self.width:
            node *= 2
            left = int(chars[node])
            if position >= begin + left and chars[node + 1]:
                begin += left
                node += 1
        return node - self.width, begin

    def edit(self, at: int, deleted: int, inserted: str, coder: Codec) -> None:
        """Replaces `deleted` characters at position `at`; positions outside of the text mean its ends."""
        at = max(0, min(at, len(self.text)))
        deleted = max(0, min(deleted, len(self.text) - at))
        first, begin = self._find(max(0, at - CONTEXT))
        self.text = self.text[:at] + inserted + self.text[at + deleted :]
        shift, safe = len(inserted) - deleted, at + deleted
        # Begins of old blocks, walked along with the new matches.
        leaves = self.chars[self.width :]
        block, old = first + 1, begin + int(leaves[first])
        pieces: list[str] = []
        for match in coder.pattern.finditer(self.text, begin):
            new = match.start()
            while block < self.width and (old + shift < new or old < safe):
                old += int(leaves[block])
                block += 1
            if block < self.width and old + shift == new:
                break
            pieces.append(match.group())
        else:
            block = self.width
        chars, tokens = self._blocks(pieces, coder)
        room = block - first
        if len(chars) > room * FULL:
            whole = [np.concatenate([x[self.width : self.width + first], y, x[self.width + block :]]) for x, y in ((self.chars, chars), (self.tokens, tokens))]
            used = whole[0] > 0
            self._grow(*(x[used] for x in whole))
            return
        for sums, fresh in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.width + first : self.width + block] = 0
            if len(fresh):
                each = -(-len(fresh) // room)
                packed = np.add.reduceat(fresh, np.arange(0, len(fresh), each))
                sums[self.width + first : self.width + first + len(packed)] = packed
            low, high = self.width + first, self.width + block - 1
            while low > 1:
                low, high = low // 2, high // 2
                sums[low : high + 1] = sums[2 * low : 2 * high + 1 : 2] + sums[2 * low + 1 : 2 * high + 2 : 2]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Copies of the lists of a column, which may be a slice of a larger one."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def build_trees(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, n_tokens, n_pre_tokens, chars, tokens): a row per document with the tree of its whole text.

    Null counts as empty. Keys pass as they are, null or repeated; other columns are ignored, and an empty table
    gives an empty result.
    """
    model = distribute(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = codec(model, pattern)
        try:
            for batch in slices(batches):
                trees = list(CountTree.build(batch.column("text").to_pylist(), coder))
                yield {"id": batch.column("id"), "text": batch.column("text"), "n_tokens": [t.count for t in trees], "n_pre_tokens": [t.encoded for t in trees], "chars": _lists([t.chars for t in trees]), "tokens": _lists([t.tokens for t in trees])}
        finally:
            coder.forget()

    given = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, text string, n_tokens long, n_pre_tokens long, chars array<int>, tokens array<int>"
    return arrow_map(given, run, schema).withColumnRenamed("id", key)


def with_edits(trees: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """trees with `edits`: of the table edits (key, seq, at, deleted, inserted) those of each key in the order of seq.

    All rows of a key get them; trees without any stay as they are. A null key has edits only if the table has
    some under null.
    """
    one = F.struct("seq", F.struct(F.col("at").cast("long").alias("at"), F.col("deleted").cast("long").alias("deleted"), F.coalesce("inserted", F.lit("")).alias("inserted")).alias("e"))
    lists = edits.groupBy(F.col(key).alias("__key")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["e"]).alias("edits"))
    return trees.join(lists, trees[key].eqNullSafe(lists["__key"]), "left").drop("__key").withColumn("edits", F.coalesce("edits", F.array().cast(EDITS)))


def apply_edits(trees: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Trees with a column `edits` after these: (key, text, n_tokens, chars, tokens, n_reencoded).

    Edits are applied one after the other, each to the text that the ones before left. n_reencoded tells how many
    pre-tokens they made be encoded; the rest of the sums is kept.
    """
    model = distribute(trees.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = codec(model, pattern)
        try:
            for batch in slices(batches, 128):
                done = []
                for text, chars, tokens, edits in zip(batch.column("text").to_pylist(), _arrays(batch.column("chars")), _arrays(batch.column("tokens")), batch.column("edits").to_pylist()):
                    tree = CountTree(text, chars, tokens)
                    for e in edits:
                        tree.edit(e["at"], e["deleted"], e["inserted"], coder)
                    done.append(tree)
                yield {"id": batch.column("id"), "text": [t.text for t in done], "n_tokens": [t.count for t in done], "chars": _lists([t.chars for t in done]), "tokens": _lists([t.tokens for t in done]), "n_reencoded": [t.encoded for t in done]}
        finally:
            coder.forget()

    given = trees.select(F.col(key).alias("id"), "text", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, text string, n_tokens long, chars array<int>, tokens array<int>, n_reencoded long"
    return arrow_map(given, run, schema).withColumnRenamed("id", key)


def sample_edits(text: str = "text"):
    """The edits of the query: a word put in at a third, three characters replaced in the middle, nine removed near the end."""
    n = F.length(text).cast("long")
    one = lambda at, deleted, inserted: F.struct(at.cast("long").alias("at"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(one(F.floor(n / 3), 0, " revised,"), one(F.floor(n / 2), 3, "'s 42\n"), one(n - F.floor(n / 5), 9, ""))


def count_edited(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_tokens, n_tokens_edited, n_pre_tokens, n_reencoded, edited_sha256.

    Trees of all whole texts are written to the shared folder, and the edits of sample_edits are applied to what is
    read from there. Null counts as empty, which can be edited as well. Null and repeated keys stay rows of their
    own; other columns are ignored, and an empty table gives an empty result.
    """
    path = f"{shared_dir(docs.sparkSession)}-trees-{uuid.uuid4().hex[:8]}.parquet"
    build_trees(docs, ranks, pattern, text, key).write.parquet(path)
    trees = docs.sparkSession.read.parquet(path)
    # The row's own counts travel inside the key, as keys may be null or repeat.
    named = trees.select(F.struct(key, "n_tokens", "n_pre_tokens").alias("row"), "text", "chars", "tokens", sample_edits().alias("edits"))
    done = apply_edits(named, ranks, pattern, "row")
    return done.select(f"row.{key}", "row.n_tokens", F.col("n_tokens").alias("n_tokens_edited"), "row.n_pre_tokens", "n_reencoded", F.sha2("text", 256).alias("edited_sha256"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Every token becomes a piece whose bytes are mapped to printable characters, scored by its negative rank:
sentencepiece then merges the adjacent pair of best score, leftmost first, as rank-based BPE merges the
pair of least rank. Normalisation is the identity. Pre-tokens are encoded separately; ids are decoded by
the inverse of the byte map. A piece's id is its rank.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import arrow_map, slices, text_or_empty

#: Entries and characters of a worker's memory of pre-tokens; it is emptied when either is reached, and after each task.
CACHE = 100_000
CACHE_CHARS = 4 << 20
#: Pre-tokens from which sentencepiece is called for all of them at once; for fewer the call costs more than it saves.
MANY = 1000
#: Characters of texts that are encoded together.
GROUP_CHARS = 1 << 20


def _byte_map() -> list[str]:
    """A visible character for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


BYTE_TO_CHAR = _byte_map()
CHAR_TO_BYTE = {c: b for b, c in enumerate(BYTE_TO_CHAR)}
_TABLE = {b: ord(c) for b, c in enumerate(BYTE_TO_CHAR)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; ranks must be 0, 1, 2, ... and hold every single byte."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    tokens = [ranks[i] for i in range(len(ranks))]
    if len({t for t in tokens if len(t) == 1}) != 256:
        raise ValueError("the vocabulary lacks single bytes")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece ModelProto of a vocabulary; the unknown piece that it requires follows the tokens."""
    normal, unknown = 1, 2
    pieces = [_field(1, "".join(map(BYTE_TO_CHAR.__getitem__, t)).encode()) + _field(2, -float(i)) + _field(3, normal) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(24, 0) + _field(40, len(tokens))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no bos, eos and pad: -1
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, nothing removed or escaped
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes whole texts with a serialised model."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        n = self.pieces.get_piece_size() - 1  # without the unknown piece
        self.bytes_of = [bytes(map(CHAR_TO_BYTE.__getitem__, self.pieces.id_to_piece(i))) for i in range(n)]
        self.ints = list(range(n))  # one object for each id, however often the memory holds it
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.sizes: dict[str, int] = {}
        self.held = 0

    def forget(self) -> None:
        self.known.clear()
        self.sizes.clear()
        self.held = 0

    def _encode(self, tokens: list[str]) -> list[list[int]]:
        mapped = [t.encode().decode("latin-1").translate(_TABLE) for t in tokens]
        return self.pieces.encode(mapped, num_threads=1) if len(mapped) >= MANY else list(map(self.pieces.encode, mapped))

    def split(self, texts: list[str]) -> Iterator[list[list[str]]]:
        """The pre-tokens of texts, of about GROUP_CHARS characters or one text at a time."""
        size, start = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= GROUP_CHARS or k + 1 == len(texts):
                yield list(map(self.pattern.findall, texts[start : k + 1]))
                size, start = 0, k + 1

    def _learn(self, tokens: set[str]) -> None:
        new = list(tokens)
        self.held += sum(map(len, new))
        for token, ids in zip(new, self._encode(new)):
            self.known[token] = (tuple(map(self.ints.__getitem__, ids)), ",".join(map(str, ids)))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Of each text the ids, and the same in decimal joined by commas."""
        for split in self.split(texts):
            if len(self.known) >= CACHE or self.held >= CACHE_CHARS:
                self.forget()
            self._learn(set(chain.from_iterable(split)).difference(self.known))
            for tokens in split:
                parts = list(map(self.known.__getitem__, tokens))
                yield list(chain.from_iterable(map(itemgetter(0), parts))), ",".join(map(itemgetter(1), parts))

    def counts(self, tokens: list[str]) -> Iterator[int]:
        """How many ids each pre-token has."""
        self.measure(set(tokens))
        return map(self.sizes.__getitem__, tokens)

    def measure(self, tokens: set[str]) -> None:
        """Remembers how many ids the pre-tokens have; others may be forgotten."""
        if len(self.sizes) >= 2 * CACHE or self.held >= 2 * CACHE_CHARS:
            self.forget()
        new = list(tokens.difference(self.sizes))
        if new:
            self.held += sum(map(len, new))
            self.sizes.update(zip(new, map(len, self._encode(new))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(model: Broadcast, pattern: str) -> Codec:
    """A codec of a model that the driver has sent to the executors: made for each task, so that none stays in a reused worker."""
    return Codec(model.value, pattern)


def distribute(spark, ranks: str) -> Broadcast:
    """Serialises the model of a rank file and sends it to all executors: some bytes for each token of the vocabulary."""
    return spark.sparkContext.broadcast(serialise(read_ranks(ranks)))


def _lists(parts: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(parts), np.int32, count=int(ends[-1]))))


def encode_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int> and decoded binary.

    Every whole text is encoded; null counts as empty, which has no ids. Keys pass as they are, of whatever
    type, null or repeated; repeated rows are encoded each on its own. Other columns are ignored, and an
    empty table gives an empty result.
    """
    model = distribute(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = codec(model, pattern)
        try:
            for batch in slices(batches):
                found = list(coder.encode(batch.column("text").to_pylist()))
                back = [coder.decode(ids) for ids, _ in found]
                out = {"id": batch.column("id"), "n_tokens": [len(ids) for ids, _ in found], "ids_sha256": [hashlib.sha256(j.encode()).hexdigest() for _, j in found], "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back]}
                yield {**out, "ids": _lists([ids for ids, _ in found]), "decoded": back} if with_ids else out
        finally:
            coder.forget()

    given = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return arrow_map(given, run, schema).withColumnRenamed("id", key)


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per row of documents: doc_id, source, n_tokens, ids array<int>, round_trip boolean.

    Null texts have no ids; null and repeated doc_ids pass as they are; an empty table gives an empty result.
    """
    model = distribute(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = codec(model, pattern)
        try:
            for batch in slices(batches, 64):  # ids take several times the memory of texts
                texts = batch.column("text").to_pylist()
                found = [ids for ids, _ in coder.encode(texts)]
                whole = [coder.decode(ids) == text.encode() for ids, text in zip(found, texts)]
                yield {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "n_tokens": list(map(len, found)), "ids": _lists(found), "round_trip": whole}
        finally:
            coder.forget()

    given = docs.select("doc_id", "source", text_or_empty().alias("text"))
    return arrow_map(given, run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, source string, n_tokens long, ids array<int>, round_trip boolean")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

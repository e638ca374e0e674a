"""Bloom filters of bounded size: tasks set bits of their rows, pieces are merged in a shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.common import arrow_map

#: Bits a row, and the most bits of a filter: 2^27 bits are 16 MB, the bound of what is broadcast.
BITS_A_ROW = 16
MAX_BITS = 1 << 27
PROBES = 2
#: Bits of the piece in which tasks ship their part of a filter.
PIECE_BITS = 1 << 18


def size_for(rows: int) -> int:
    """A power of two; beyond MAX_BITS a filter lets more rows through instead of growing, or takes sections of the keys in turn."""
    return min(MAX_BITS, 1 << max(18, (max(rows, 1) * BITS_A_ROW - 1).bit_length()))


def sections(rows: int) -> int:
    """Into how many sections keys must be cut so that a filter of each holds its rate of false alarms."""
    return max(1, -(-rows * BITS_A_ROW // MAX_BITS))


def probes(keys: np.ndarray | Sequence[bytes], bits: int) -> np.ndarray:
    """The bits of each key, one column a probe. Keys are digests of at least 16 bytes or an array of 64-bit integers."""
    if not len(keys):
        return np.zeros((0, PROBES), np.int64)
    if isinstance(keys, np.ndarray):
        x = keys.astype(np.int64, copy=False).view(np.uint64)
        raw = np.stack([_mixed(x), _mixed(x ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    else:
        raw = np.frombuffer(b"".join(k[:16] for k in keys), dtype="<u8").reshape(-1, 2)
    return (raw & np.uint64(bits - 1)).astype(np.int64)


def keys_of(column: pa.Array) -> np.ndarray | list[bytes]:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else column.to_pylist()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pack(ids: np.ndarray) -> bytes:
    """Sorted distinct bit numbers as compressed gaps."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), dtype="<u4").astype(np.int64))


def build(rows: DataFrame, key: str, bits: int, times: int = 1) -> np.ndarray:
    """The filter of the keys as bytes: bits that at least `times` (1 or 2) rows have set.

    Every probe of a key that occurs twice is set twice, so with times=2 a key whose bits aren't all set
    occurs once for certain.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for column in probes(keys_of(batch.column(0)), bits).T:
                hit, n = np.unique(column, return_counts=True)
                byte, bit = hit >> 3, np.left_shift(1, hit & 7).astype(np.uint8)
                more = (n > 1) | ((once[byte] & bit) > 0)
                np.bitwise_or.at(twice, byte[more], bit[more])
                np.bitwise_or.at(once, byte, bit)
        out = []
        for filled in (once, twice)[:times]:  # a bit that one task set twice is shipped at both levels
            pieces = filled.reshape(-1, PIECE_BITS // 8)
            for piece in np.flatnonzero(pieces.any(axis=1)):
                out.append((int(piece), _pack(np.flatnonzero(np.unpackbits(pieces[piece], bitorder="little")))))
            yield {"piece": [p for p, _ in out], "ids": [i for _, i in out]}
            out = []

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        # A task ships at most two lists for a piece, and what all of them ship for it are the bits that rows have set.
        counts = np.zeros(PIECE_BITS, dtype=np.uint8)
        for data in pdf["ids"]:
            ids = _unpack(data)
            counts[ids] = np.minimum(counts[ids] + 1, 2)
        return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "ids": [_pack(np.flatnonzero(counts >= times))]})

    parts = arrow_map(rows.select(key), local, "piece int, ids binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.groupBy("piece").applyInPandas(merge, "piece int, ids binary").toLocalIterator():
        piece = np.zeros(PIECE_BITS, dtype=np.uint8)
        piece[_unpack(row["ids"])] = 1
        at = row["piece"] * PIECE_BITS // 8
        out[at : at + PIECE_BITS // 8] = np.packbits(piece, bitorder="little")
    return out


def among(keys: np.ndarray | Sequence[bytes], filled: np.ndarray) -> np.ndarray:
    """Of each key: may it be in the filter?"""
    at = probes(keys, len(filled) * 8)
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

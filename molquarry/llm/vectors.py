"""Vectors as flat numpy arrays: packed bit vectors under Tanimoto, unit float vectors under cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.session import spread


class Bits:
    """Packed 0/1 vectors under Tanimoto similarity."""

    def __init__(self, words: np.ndarray):
        self.words = np.ascontiguousarray(words)
        self.ones = np.bitwise_count(self.words).sum(1).astype(np.int32)

    @classmethod
    def from_flat(cls, flat: np.ndarray, n: int) -> Bits:
        return cls(flat.view(np.uint64).reshape(n, -1) if n else np.zeros((0, 1), np.uint64))

    @classmethod
    def from_bytes(cls, rows: list[bytes]) -> Bits:
        return cls.from_flat(np.frombuffer(b"".join(rows), np.uint8), len(rows))

    def __len__(self) -> int:
        return len(self.words)

    def sims(self, other: Bits, a: np.ndarray, b: np.ndarray, dtype: type = np.float32) -> np.ndarray:
        """Similarity of own rows a[i] and rows b[i] of ``other``."""
        out = np.empty(len(a), dtype)
        for at in range(0, len(a), 65_536):
            i, j = a[at : at + 65_536], b[at : at + 65_536]
            both = np.bitwise_count(self.words[i] & other.words[j]).sum(1, dtype=np.int32)
            out[at : at + 65_536] = both / np.maximum(self.ones[i] + other.ones[j] - both, 1)
        return out

    def cross(self, other: Bits) -> np.ndarray:
        both = np.zeros((len(self), len(other)), np.int32)
        for at in range(0, len(self), 64):
            both[at : at + 64] = np.bitwise_count(self.words[at : at + 64, None, :] & other.words[None]).sum(2, dtype=np.int32)
        return (both / np.maximum(self.ones[:, None] + other.ones[None] - both, 1)).astype(np.float32)

    def take(self, rows: np.ndarray) -> Bits:
        return Bits(self.words[rows])

    def locality(self, seed: int = 23) -> np.ndarray:
        """One MinHash value of each row: equal for two rows with probability of their similarity."""
        n = len(self)
        if not n:
            return np.zeros(0, np.int64)
        dense = np.unpackbits(self.words.view(np.uint8).reshape(n, -1), axis=1)
        value = np.random.default_rng(seed).permutation(dense.shape[1])
        rows, cols = np.nonzero(dense)
        return np.minimum.reduceat(value[cols], np.searchsorted(rows, np.arange(n))).astype(np.int64)

    def anchors(self, seed: int) -> np.ndarray:
        """A finer locality value: two MinHash values at once."""
        return self.locality(2 * seed) * 65_536 + self.locality(2 * seed + 1)

    def coarse(self, words: int = 8) -> Bits:
        """Folded to ``words`` 64-bit words for finding the way in a graph; 0 words leaves it as it is."""
        w = self.words.shape[1]
        if not words or w <= words or w % words:
            return self
        return Bits(np.bitwise_or.reduce(self.words.reshape(len(self.words), w // words, words), axis=1))


class Units:
    """Float vectors of length 1 under cosine similarity."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)

    @classmethod
    def from_flat(cls, flat: np.ndarray, n: int) -> Units:
        return cls(flat.view(np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32))

    @classmethod
    def from_bytes(cls, rows: list[bytes]) -> Units:
        return cls.from_flat(np.frombuffer(b"".join(rows), np.uint8), len(rows))

    def __len__(self) -> int:
        return len(self.x)

    def sims(self, other: Units, a: np.ndarray, b: np.ndarray, dtype: type = np.float32) -> np.ndarray:
        out = np.empty(len(a), dtype)
        for at in range(0, len(a), 65_536):
            x, y = self.x[a[at : at + 65_536]], other.x[b[at : at + 65_536]]
            out[at : at + 65_536] = np.einsum("ij,ij->i", x.astype(dtype, copy=False), y.astype(dtype, copy=False))
        return out

    def cross(self, other: Units) -> np.ndarray:
        return self.x @ other.x.T

    def take(self, rows: np.ndarray) -> Units:
        return Units(self.x[rows])

    def locality(self, seed: int = 23, bits: int = 12) -> np.ndarray:
        """Signs of random projections: likely equal for vectors that are close."""
        signs = self.x @ np.random.default_rng(seed).standard_normal((self.x.shape[1], bits)).astype(np.float32) > 0
        return (signs << np.arange(bits)).sum(1).astype(np.int64)

    def anchors(self, seed: int) -> np.ndarray:
        """A finer locality value."""
        return self.locality(seed, 16)

    def coarse(self, words: int = 0) -> Units:
        return self


KINDS = {"bits": Bits, "units": Units}


def packed(rows: DataFrame, row_id: str, column: str, kind: str, width: int) -> DataFrame:
    """(id, vec): usable vectors as bytes, one pass over Arrow buffers without Python objects.

    ``bits``: 0/1 arrays of ``width`` packed into bits; ``units``: float arrays of ``width`` scaled to
    length 1. Null vectors, those of another length, all zero, with nulls inside, or holding NaN or
    infinity are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            n = np.diff(np.asarray(col.offsets))
            good = np.asarray(col.is_valid()) & (n == width)
            start = np.asarray(col.offsets)[:-1][good] - np.asarray(col.offsets)[0]
            flat = col.flatten()
            if flat.null_count:
                holes = np.concatenate([[0], np.cumsum(~np.asarray(flat.is_valid()))])
                whole = holes[start + width] == holes[start]
                good[np.flatnonzero(good)[~whole]] = False
                start = start[whole]
                flat = flat.fill_null(0)
            values = flat.to_numpy(zero_copy_only=False)
            x = np.stack([values[s : s + width] for s in start]) if len(start) else np.zeros((0, width), values.dtype)
            if kind == "bits":
                use = (x != 0).any(1)
                data = np.packbits(x[use] != 0, axis=1)
            else:
                x = x.astype(np.float64)
                norm = np.sqrt((x * x).sum(1))
                use = np.isfinite(norm) & (norm > 0)
                data = (x[use] / norm[use, None]).astype(np.float32)
            ids = b.column(0).filter(pa.array(good)).filter(pa.array(use))
            size = data.shape[1] * data.itemsize if data.ndim == 2 else 0
            ends = np.arange(len(data) + 1, dtype=np.int32) * size
            vec = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([ids, vec], ["id", "vec"])

    kinds = dict(rows.dtypes)
    src = rows.select(F.col(row_id).alias("id"), F.col(column).alias("v")).filter(F.col("v").isNotNull())
    return spread(src, 1).mapInArrow(run, f"id {kinds[row_id]}, vec binary")

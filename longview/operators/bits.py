"""Slices as bytes, so that shuffles carry masks at one bit a pixel and pixels at sixteen where their values allow it.

A slice's first byte names how the rest is laid out. Inside a task, masks are 64-bit words, 64 pixels each, on which morphology is
shifts, ands and ors; a row starts on a word of its own, and bits beyond the last column stay clear.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.session import small_batches

MASK = b"b"
KINDS = {b"h": np.dtype("<i2"), b"i": np.dtype("<i4"), b"q": np.dtype("<i8"), b"d": np.dtype("<f8")}


def pixel_bytes(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three widths that holds them all; others as doubles."""
    a = np.asarray(values)
    if a.dtype.kind not in "iub":
        return b"d" + a.astype("<f8").tobytes()
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    for tag in (b"h", b"i"):
        limits = np.iinfo(KINDS[tag])
        if limits.min <= low and high <= limits.max:
            return tag + a.astype(KINDS[tag]).tobytes()
    return b"q" + a.astype("<i8").tobytes()


def mask_bytes(mask: np.ndarray) -> bytes:
    """A two-dimensional mask, each row in whole bytes."""
    return MASK + np.packbits(mask != 0, axis=1, bitorder="little").tobytes()


def plane(data: bytes, rows: int, cols: int) -> np.ndarray:
    """Pixels or a mask (as booleans) from bytes."""
    tag, body = data[:1], memoryview(data)[1:]
    if tag == MASK:
        packed = np.frombuffer(body, np.uint8).reshape(rows, -1)
        return np.unpackbits(packed, axis=1, count=cols, bitorder="little").astype(bool)
    return np.frombuffer(body, KINDS[tag]).reshape(rows, cols)


def stack(parts: Sequence[bytes], rows: int, cols: int) -> np.ndarray:
    tag, size = parts[0][:1], len(parts[0])
    if all(p[:1] == tag and len(p) == size for p in parts):  # one layout: read at once
        body = np.frombuffer(b"".join([p[1:] for p in parts]), np.uint8)
        if tag == MASK:
            return np.unpackbits(body.reshape(len(parts), rows, -1), axis=2, count=cols, bitorder="little").astype(bool)
        return body.view(KINDS[tag]).reshape(len(parts), rows, cols)
    return np.stack([plane(p, rows, cols) for p in parts])


# ------------------------------------------------------------------ words

def words_of(parts: Sequence[bytes], rows: int, cols: int) -> np.ndarray:
    """Mask slices as words: (slices, rows, words of a row)."""
    wide = (cols + 7) // 8
    out = np.zeros((len(parts), rows, (wide + 7) // 8 * 8), np.uint8)
    out[:, :, :wide] = np.frombuffer(b"".join([p[1:] for p in parts]), np.uint8).reshape(len(parts), rows, wide)
    return out.view("<u8")


def words_from(mask: np.ndarray) -> np.ndarray:
    """A boolean stack as words."""
    packed = np.packbits(mask, axis=2, bitorder="little")
    pad = -packed.shape[2] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, 0), (0, pad)))).view("<u8")


def booleans(words: np.ndarray, cols: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=2, count=cols, bitorder="little").astype(bool)


def slice_bytes(words: np.ndarray, cols: int) -> list[bytes]:
    wide = (cols + 7) // 8
    return [MASK + np.ascontiguousarray(s).tobytes() for s in words.view(np.uint8)[:, :, :wide]]


def _valid(words: int, cols: int) -> np.ndarray:
    return words_from(np.ones((1, 1, cols), bool))[0, 0, :words]


def _sides(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The neighbour below and above along z or y; outside is clear."""
    before, after = np.zeros_like(a), np.zeros_like(a)
    at = [slice(None)] * 3
    here, there = at.copy(), at.copy()
    here[axis], there[axis] = slice(1, None), slice(None, -1)
    before[tuple(here)] = a[tuple(there)]
    after[tuple(there)] = a[tuple(here)]
    return before, after


def _across(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbour left and right, bits carried from word to word."""
    left, right = a << np.uint64(1), a >> np.uint64(1)
    left[:, :, 1:] |= a[:, :, :-1] >> np.uint64(63)
    right[:, :, :-1] |= a[:, :, 1:] << np.uint64(63)
    return left, right


def grown(words: np.ndarray, cols: int) -> np.ndarray:
    """Dilation by a 3x3x3 cube."""
    valid = _valid(words.shape[2], cols)
    for sides in (_across, lambda a: _sides(a, 1), lambda a: _sides(a, 0)):
        a, b = sides(words)
        words = (words | a | b) & valid
    return words


def shrunk(words: np.ndarray, iterations: int = 1) -> np.ndarray:
    """Erosion by a 3x3x3 cube, repeated; outside is clear."""
    for _ in range(iterations):
        for sides in (_across, lambda a: _sides(a, 1), lambda a: _sides(a, 0)):
            a, b = sides(words)
            words = words & a & b
    return words


# ---------------------------------------------------------------- columns

def _over(kind: str, fn, *cols: Column) -> Column:
    """A row-wise function of arrays, in Arrow batches; a null first argument gives null."""

    @F.pandas_udf(kind)
    def made(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in parts:
            yield pd.Series([None if v[0] is None else fn(*v) for v in zip(*series)], dtype=object)

    return made(*cols)


def packed_pixels(px: Column) -> Column:
    return _over("binary", lambda a, _: pixel_bytes(a), px, F.lit(0))


def packed_mask(mask: Column, rows: Column, cols: Column) -> Column:
    return _over("binary", lambda a, h, w: mask_bytes(np.asarray(a).reshape(h, w)), mask, rows, cols)


def packed_below(px: Column, rows: Column, cols: Column, limit: float) -> Column:
    """The mask of pixels below a limit."""
    return _over("binary", lambda a, h, w: mask_bytes((np.asarray(a) < limit).reshape(h, w)), px, rows, cols)


def pixels(data: Column, rows: Column, cols: Column, kind: str = "int") -> Column:
    """Packed pixels or a packed mask as an array again."""
    dtype = {"int": np.int32, "double": np.float64}[kind]
    return _over(f"array<{kind}>", lambda b, h, w: plane(b, h, w).ravel().astype(dtype), data, rows, cols)


def count_set(mask: Column) -> Column:
    """Set pixels of a packed mask."""
    return _over("bigint", lambda b, _: int(np.bitwise_count(np.frombuffer(b, np.uint8, offset=1)).sum()), mask, F.lit(0))


def is_packed(slices: DataFrame, column: str) -> bool:
    return isinstance(slices.schema[column].dataType, T.BinaryType)


def with_packed_mask(slices: DataFrame, mask: str) -> DataFrame:
    small_batches(slices.sparkSession)
    return slices if is_packed(slices, mask) else slices.withColumn(mask, packed_mask(F.col(mask), F.col("rows"), F.col("cols")))


def with_packed_pixels(slices: DataFrame, *columns: str) -> DataFrame:
    small_batches(slices.sparkSession)
    return slices.withColumns({c: packed_pixels(F.col(c)) for c in columns if not is_packed(slices, c)})

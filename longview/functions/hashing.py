"""Hash split of ids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published split.
DEFAULT_SEED = "nlst-v1"
DEFAULT_FRACTIONS = (0.70, 0.15, 0.15)
SPLITS = ("train", "val", "test")
BUCKETS = 10_000

_CHUNK = 12  # hex digits that fit a signed 64-bit integer


def split_bucket(id_: Column, seed: str = DEFAULT_SEED) -> Column:
    """SHA-256 of ``seed:id`` modulo 10,000, as a native expression.

    The 256-bit digest is reduced twelve hex digits at a time, so no value
    leaves 64 bits and no Python runs.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)
    acc: Column | None = None
    for start in range(1, 65, _CHUNK):
        width = min(_CHUNK, 65 - start)
        part = F.conv(F.substring(digest, start, width), 16, 10).cast("bigint")
        acc = part if acc is None else acc * F.lit(pow(16, width, BUCKETS)) + part
        acc = acc % F.lit(BUCKETS)
    return acc


def split_value(id_: Column, seed: str = DEFAULT_SEED) -> Column:
    return split_bucket(id_, seed) / F.lit(float(BUCKETS))


def check_fractions(fractions: Sequence[float]) -> tuple[float, float, float]:
    if len(fractions) != 3:
        raise ValueError(f"expected three fractions (train, val, test), got {fractions!r}")
    if not math.isclose(sum(fractions), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"fractions must add up to 1, got {fractions!r}")
    if min(fractions) < 0:
        raise ValueError(f"fractions must not be negative, got {fractions!r}")
    train, val, test = (float(f) for f in fractions)
    return train, val, test


def assign_split(id_: Column, seed: str = DEFAULT_SEED, fractions: Sequence[float] = DEFAULT_FRACTIONS) -> Column:
    train, val, _ = check_fractions(fractions)
    r = split_value(id_, seed)
    return F.when(r < train, "train").when(r < train + val, "val").when(r.isNotNull(), "test")


def hash_order(id_: Column, seed: int | str) -> Column:
    """A seeded pseudo-random sort key, the same on every run and partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)

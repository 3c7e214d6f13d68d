"""Ordered scans over groups of any size.

A window over a group runs in one task, which a hot group overwhelms. Here the
rows are laid out by range over (keys, order) and sorted, so a group may span
many partitions. Each partition is then scanned where it lies, batch by batch,
with its state carried along; what a group brings in from earlier partitions is
worked out from one summary row per partition. Nothing is shuffled again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.session import cut

PART = "_part"
SUMMARY = "part int, state binary"


def _starts(keys: list[pa.Array], before: tuple | None, n: int) -> np.ndarray:
    """Which rows start a group; ``before`` is the key of the row before the first."""
    out = np.zeros(n, bool)
    for key in keys:
        if n > 1:
            a, b = key.slice(0, n - 1), key.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            out[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    out[0] = before is None or before != _key(keys, 0)
    return out


def _key(keys: list[pa.Array], i: int) -> tuple:
    return tuple(k[i].as_py() for k in keys)


def _running(values: np.ndarray, first: np.ndarray, state):
    """Sums along the rows that start anew where ``first`` is set; ``state`` goes into the first group if it goes on."""
    edges = np.flatnonzero(first)
    if values.dtype.kind == "f":  # one group at a time: a difference of long sums would lose digits
        out = np.empty(len(values))
        for a, b in zip(np.r_[0, edges], np.r_[edges, len(values)]):
            if a < b:
                out[a:b] = np.cumsum(np.r_[0.0 if first[a] else state, values[a:b]])[1:]
        return out
    total = np.cumsum(values)
    base = np.zeros(len(values), values.dtype)
    if len(edges):
        base[edges] = total[edges] - values[edges]
        at = np.maximum.accumulate(np.where(first, np.arange(len(values)), -1))
        total = np.where(at >= 0, total - base[np.maximum(at, 0)], total + state)
        return total
    return total + state


class OrderedScan:
    """Rows of ``df`` ascending by (keys, order); ``order`` should end in a unique column."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys = list(keys)
        self.order = list(order)
        laid = df.repartitionByRange(*self.keys, *self.order).sortWithinPartitions(*self.keys, *self.order)
        # The partition number is part of the result, so it must not change on a retry.
        self.df = cut(laid.withColumn(PART, F.spark_partition_id()))

    def running(self, **sums: Column) -> OrderedScan:
        """Add inclusive running sums, nulls counting as zero; exclusive ones are the sum less the row's own value."""
        own = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
        types = self.df.select(*[F.sum(c).alias(n) for n, c in own.items()]).schema
        own = {f.name: own[f.name].cast(f.dataType) for f in types}

        def last(values, first, state):
            # The sums of the last group, and whether the partition has begun no other.
            ends = [_running(v.to_numpy(), first, s) for v, s in zip(values, state or [0] * len(values))]
            return [e[-1].item() for e in ends]

        def carry(parts):
            state, out = None, {}
            for part, head, tail, single, ends in parts:
                goes_on = state is not None and state[0] == head
                if goes_on:
                    out[part] = state
                state = (tail, [a + b for a, b in zip(ends, state[1])] if goes_on and single else ends)
            return out

        def fill(values, first, state):
            sums = [_running(v.to_numpy(), first, s) for v, s in zip(values, state or [0] * len(values))]
            return [pa.array(s) for s in sums], [s[-1].item() for s in sums]

        return self._scan(own, [T.StructField(f.name, f.dataType) for f in types], last, carry, fill)

    def row_number(self, name: str) -> OrderedScan:
        return self.running(**{name: F.lit(1).cast("bigint")})

    def total(self, **sums: Column) -> OrderedScan:
        """Add the group's whole sums, nulls counting as zero, to every row.

        A group that ends in the batch it began in is summed there. Of longer ones a first pass notes the sums; a batch has one
        group at most that goes on, so the driver gets no more notes than there are batches, and two for each partition.
        """
        own = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
        types = self.df.select(*[F.sum(c).alias(n) for n, c in own.items()]).schema
        own = {f.name: own[f.name].cast(f.dataType) for f in types}
        n_keys, n_sums = len(self.keys), len(own)

        def segments(batch, before):
            keys = batch.columns[1 : 1 + n_keys]
            first = _starts(keys, before, batch.num_rows)
            edges = np.flatnonzero(first)
            starts = edges if first[0] else np.r_[0, edges]
            return keys, first, starts

        def notes(batches):
            key, held, rows, out = None, [0] * n_sums, 0, []
            part = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = batch.columns[0][0].as_py()
                keys, first, starts = segments(batch, key)
                parts = [np.add.reduceat(v.to_numpy(), starts) for v in batch.columns[1 + n_keys :]]
                if first[0] and key is not None:
                    out.append((key, held, rows))
                    held, rows = [0] * n_sums, 0
                held, rows = [h + p[0].item() for h, p in zip(held, parts)], rows + 1
                if len(starts) > 1:
                    out.append((_key(keys, 0), held, rows))
                    held, rows = [p[-1].item() for p in parts], 1
                key = _key(keys, batch.num_rows - 1)
            if key is not None:
                out.append((key, held, rows))
                # Groups in one batch need no note, but the first and the last may go on in another partition.
                kept = [o for i, o in enumerate(out) if o[2] > 1 or i in (0, len(out) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(kept)])], names=["part", "state"])

        slim = self.df.select(PART, *self.keys, *[c.alias(f"_v_{n}") for n, c in own.items()])
        noted: dict[tuple, list] = {}
        for r in sorted(slim.mapInArrow(notes, SUMMARY).collect()):
            for key, held, _ in pickle.loads(r["state"]):
                noted[key] = [a + b for a, b in zip(noted.get(key, [0] * n_sums), held)]
        sent = self.df.sparkSession.sparkContext.broadcast(noted)
        rest = [c for c in self.df.columns if c not in own]
        wide = self.df.select(PART, *[F.col(k).alias(f"_k_{k}") for k in self.keys], *[c.alias(f"_v_{n}") for n, c in own.items()], *rest)
        schema = T.StructType([*self.df.select(*rest).schema.fields, *[T.StructField(f.name, f.dataType) for f in types]])

        def filled(batch):
            keys, _, starts = segments(batch, None)
            size, made = np.diff(np.r_[starts, batch.num_rows]), []
            for j, v in enumerate(batch.columns[1 + n_keys : 1 + n_keys + n_sums]):
                whole = np.add.reduceat(v.to_numpy(), starts)
                for at in (0, len(starts) - 1):
                    known = sent.value.get(_key(keys, int(starts[at])))
                    if known is not None:
                        whole[at] = known[j]
                made.append(pa.array(np.repeat(whole, size)))
            return pa.RecordBatch.from_arrays([*batch.columns[1 + n_keys + n_sums :], *made], names=schema.names)

        def run(batches):
            held = None
            for batch in batches:
                batch = batch if held is None else pa.concat_batches([held, batch])
                held = None
                if not batch.num_rows:
                    continue
                keys, _, starts = segments(batch, None)
                # Batches may be cut elsewhere than in the first pass: a short group waits for its rest.
                if _key(keys, int(starts[-1])) not in sent.value:
                    held, batch = batch.slice(int(starts[-1])), batch.slice(0, int(starts[-1]))
                if batch.num_rows:
                    yield filled(batch)
            if held is not None and held.num_rows:
                yield filled(held)

        return self._with(wide.mapInArrow(run, schema))

    def lag(self, **values: Column) -> OrderedScan:
        """Add the previous row's values within the group; null on a group's first row."""
        fields = [T.StructField(f.name, f.dataType) for f in self.df.select(*[c.alias(n) for n, c in values.items()]).schema]

        def last(values, first, state):
            return [v[len(first) - 1].as_py() for v in values]

        def carry(parts):
            state, out = None, {}
            for part, head, tail, _, ends in parts:
                if state is not None and state[0] == head:
                    out[part] = state
                state = (tail, ends)
            return out

        def fill(values, first, state):
            n, out = len(first), []
            at = pa.array(np.arange(-1, n - 1), mask=first | (np.arange(n) == 0))
            for i, v in enumerate(values):
                column = v.take(at)
                if not first[0]:
                    column = pa.concat_arrays([pa.array([state[i]], v.type), column.slice(1)])
                out.append(column)
            return out, last(values, first, state)

        return self._scan(dict(values), fields, last, carry, fill)

    def result(self) -> DataFrame:
        return self.df.drop(PART)

    def _scan(self, values: dict[str, Column], fields: list[T.StructField], last: Callable, carry: Callable, fill: Callable) -> OrderedScan:
        """Add a column for each of ``values``: one pass for the summaries, one for the rows.

        The summaries hold a partition's first and last key and the state at its end, so the driver sees one row per partition.
        """
        n_keys, names = len(self.keys), list(values)

        def grouped(batches: Iterator[pa.RecordBatch], state: dict):
            for batch in batches:
                if not batch.num_rows:
                    continue
                cols = batch.columns
                part, keys, own = cols[0][0].as_py(), cols[1 : 1 + n_keys], cols[1 + n_keys : 1 + n_keys + len(names)]
                first = _starts(keys, state.get(part, (None,))[0], batch.num_rows)
                yield batch, part, keys, own, first

        def summarise(batches):
            state, heads, single = {}, {}, {}
            for batch, part, keys, own, first in grouped(batches, state):
                if part not in heads:
                    heads[part], single[part] = _key(keys, 0), True
                    first[0] = False  # alone, the partition starts from nothing
                single[part] &= not first.any()
                state[part] = (_key(keys, batch.num_rows - 1), last(own, first, state[part][1] if part in state else None))
            for part, (tail, ends) in state.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps((heads[part], tail, single[part], ends))])], names=["part", "state"])

        slim = self.df.select(PART, *self.keys, *[c.alias(f"_v_{n}") for n, c in values.items()])
        parts = sorted((r["part"], *pickle.loads(r["state"])) for r in slim.mapInArrow(summarise, SUMMARY).collect())
        carried = carry(parts)
        rest = [c for c in self.df.columns if c not in names]
        wide = self.df.select(PART, *[F.col(k).alias(f"_k_{k}") for k in self.keys], *[c.alias(f"_v_{n}") for n, c in values.items()], *rest)
        schema = T.StructType([*self.df.select(*rest).schema.fields, *fields])

        def run(batches):
            state = dict(carried)
            for batch, part, _, own, first in grouped(batches, state):
                made, ends = fill(own, first, state[part][1] if part in state else None)
                state[part] = (_key(batch.columns[1 : 1 + n_keys], batch.num_rows - 1), ends)
                yield pa.RecordBatch.from_arrays([*batch.columns[1 + n_keys + len(names) :], *made], names=schema.names)

        return self._with(wide.mapInArrow(run, schema))

    def _with(self, df: DataFrame) -> OrderedScan:
        new = object.__new__(type(self))
        new.keys, new.order, new.df = self.keys, self.order, df
        return new


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median per group (mean of the middle two), nulls ignored, for groups of any size.

    Equal values are counted first; the middle is then found by an ordered scan.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ran = OrderedScan(counts, keys, ["_v"]).running(_to=F.col("_c")).result()
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        sized = ran.join(total, keys)
    else:
        sized = ran.withColumn("_n", total.scalar())
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    covers = lambda at: (F.col("_to") - F.col("_c") <= at) & (at < F.col("_to"))
    mid = sized.filter(covers(low) | covers(high))
    pair = F.max(F.when(covers(low), F.col("_v").cast("double"))) + F.max(F.when(covers(high), F.col("_v").cast("double")))
    return mid.groupBy(*keys).agg((pair / 2).alias(name))

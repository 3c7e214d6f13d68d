"""Connected components of edge tables by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.session import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges tied to the smallest one it reaches over them; nodes that are that one are left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        # The labels of both ends fall, not only the ends: a long chain is joined from many places at once.
        for at in (left, right, label[left], label[right]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = label != np.arange(len(nodes))
    return nodes[tied], nodes[label[tied]]


def _contracted(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same components by at most as many edges: each batch of a partition keeps a forest of stars only."""

    def run(batches):
        for pdf in batches:
            for key, own in pdf.groupby(list(keys), sort=False) if keys else [((), pdf)]:
                a, b = forest(own["a"].to_numpy(), own["b"].to_numpy())
                out = pd.DataFrame(dict(zip(keys, key)), index=range(len(a)), columns=list(keys))
                yield out.assign(a=a, b=b)

    return edges.mapInPandas(run, edges.schema)


def components(edges: DataFrame, keys: Sequence[str] = (), counter: list | None = None) -> DataFrame:
    """keys, node and component: the smallest node reachable, for every node that an edge (keys, a, b) names; a and b are longs.

    Edges of one key are brought together and contracted batch by batch, which bounds memory whatever a key holds. Then stars
    alternate: every node's larger neighbours are tied to the smallest node around it (large), its smaller ones and itself to the
    smallest of them (small), until nothing changes. The rounds grow with the logarithm of the longest path; ``counter`` is
    given one entry for each. Every round is written, so a lost executor costs one round.
    """
    keys = list(keys)
    plain = edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    # Sorted, so that neighbours on a path meet in one batch.
    dealt = plain.repartition(*keys).sortWithinPartitions(*keys, "b", "a") if keys else plain
    now, seen = cut(_contracted(dealt, keys)), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        if not state[0]:
            break
        if counter is not None:
            counter.append(state[0])
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("_low"))
        large = both.where("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("_low").alias("b")).distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("_low"))
        tied = large.join(least, [*keys, "a"]).where("b <> _low").select(*keys, F.col("b").alias("a"), F.col("_low").alias("b"))
        now = cut(tied.unionByName(least.select(*keys, "a", F.col("_low").alias("b"))).distinct())
    ends = now.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)

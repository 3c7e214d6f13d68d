"""Best-fit packing of documents into sequences of fixed capacity, with conflicts between documents."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import SPACE, table
from longview.llm.simhash import near_groups, shingle_fingerprint
from longview.session import cut

CAPACITY, SHARD_ROWS = 2048, 4096
#: Differing bits at which two texts' fingerprints count as one duplicate cluster.
CLUSTER_BITS = 5
PLACED = "bin_id long, slot int, bin_offset long, doc_id long, source string, piece int, start_token long, n_tokens long"


class Bins:
    """Open bins in order of their residual; each carries a bitmap of the sources and one of the duplicate clusters it holds."""

    STEP = 64

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity, self.words = capacity, (sources + clusters + 63) // 64 or 1
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.bits = np.zeros((64, self.words), np.uint64)
        self.n = 0

    def place(self, size: int, marks: list[int]) -> tuple[int, int]:
        """(bin, tokens already in it): the tightest bin with room and none of the marks, or else a new one."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            ids = np.fromiter((b for _, b in self.order[at : at + self.STEP]), np.int64)
            taken = np.zeros(len(ids), bool)
            for m in marks:
                taken |= (self.bits[ids, m >> 6] >> np.uint64(m & 63) & np.uint64(1)).astype(bool)
            free = np.flatnonzero(~taken)
            if len(free):
                residual, chosen = self.order.pop(at + int(free[0]))
                break
            at += self.STEP
        else:
            residual, chosen = self.capacity, self.n
            self.n += 1
            if self.n > len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        for m in marks:
            self.bits[chosen, m >> 6] |= np.uint64(1 << (m & 63))
        insort(self.order, (residual - size, chosen))
        return chosen, self.capacity - residual


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins for one shard: long documents first fill whole bins of their own; what is left goes in by falling size."""
    rows = rows.sort_values(["n", "doc_id", "cluster", "row"], ascending=[False, True, True, True], na_position="first")
    source = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    cluster = pd.factorize(rows["cluster"], use_na_sentinel=False)[0]
    rest = (rows["n"] % capacity).to_numpy()
    full = (rows["n"] // capacity).to_numpy()
    bins = Bins(capacity, source.max() + 1, cluster.max() + 1)
    first = int(source.max()) + 1
    shard = int(rows["shard"].iloc[0]) << 32
    ids, names = rows["doc_id"].tolist(), rows["source"].tolist()
    out, filled = [], {}
    for i in sorted(range(len(rows)), key=lambda k: -rest[k]):
        if rest[i] or not full[i]:
            b, used = bins.place(int(rest[i]), [int(source[i]), first + int(cluster[i])])
            filled[b] = filled.get(b, -1) + 1
            out.append((shard + b, filled[b], used, ids[i], names[i], int(full[i]), int(full[i]) * capacity, int(rest[i])))
    b = bins.n
    for i in np.flatnonzero(full):
        for piece in range(int(full[i])):
            out.append((shard + b, 0, 0, ids[i], names[i], piece, piece * capacity, capacity))
            b += 1
    made = pd.DataFrame(out, columns=[c.split()[0] for c in PLACED.split(", ")])
    return made.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Where every token of ``docs`` (doc_id, source, cluster, n) goes: one row for each piece of a document.

    No bin holds more than ``capacity`` tokens, two documents of one source, or two of one duplicate cluster. A document is
    cut only where it is longer than a bin. Rows are dealt by hash into shards of about ``shard_rows`` that are packed by
    themselves, so a task's bins have a bound however much of the input one source holds; null source and cluster count as
    values. Documents of no tokens take a place of size zero. Repeated rows are packed one by one. The rows' numbers, which
    break ties, come from the written table, so a lost executor repeats the same packing.
    """
    rows = cut(docs.select("doc_id", "source", "cluster", "n", F.monotonically_increasing_id().alias("row")))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda g: pack_shard(g, capacity), PLACED)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, cluster (equal texts) and n (words between the six ASCII separators; null: none)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.xxhash64(text).alias("cluster"), F.size(F.array_remove(F.split(text, SPACE + "+"), "")).cast("long").alias("n"))


def clustered(docs: DataFrame) -> DataFrame:
    """As ``sized``, but texts whose fingerprints over five-word shingles are linked at CLUSTER_BITS of 64 or fewer share their cluster.

    One fingerprint a text, as the near-duplicate operator has it: equal texts are always one cluster, lightly changed ones mostly
    (94 % of pairs of similarity 0.98 in a simulation, 68 % at 0.95, 37 % at 0.90).
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = cut(shingle_fingerprint(docs.select(mark.alias("cluster"), "text"), ["cluster"], size=5).distinct())
    groups = near_groups(prints, CLUSTER_BITS).select("cluster", "group")
    return sized(docs).join(groups, "cluster").select("doc_id", "source", F.col("group").alias("cluster"), "n")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words over all documents; near copies are one cluster."""
    return pack(clustered(table(spark, sf_dir, "documents")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document that came this far; near copies are gone, so only equal texts are a cluster."""
    del spark, sf_dir
    return pack(sized(docs))


QUERIES = {"op5_best_fit_packing": (op5_best_fit_packing, None)}

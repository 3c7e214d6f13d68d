"""Extendible hashing: a shard that holds too many bytes splits on the next bit of its rows' hash, and no other does."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import table
from longview.session import cut

BITS = 60
LIMIT_BYTES = 1 << 20


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, h (60 bits of the MD5 of id and text) and bytes of the text; rows that are equal in both have equal hashes."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def _prefix(depth):
    return F.shiftright(F.col("h"), BITS - depth)


def prefix_sums(rows: DataFrame, low: int, high: int) -> DataFrame:
    """d, q, total: the bytes under every used prefix q of ``low`` to ``high`` bits; summed once over the longest, then upwards."""
    ends = rows.groupBy(_prefix(high).alias("p")).agg(F.sum("bytes").alias("bytes"))
    levels = ends.select("p", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"))
    return levels.groupBy("d", F.expr(f"shiftright(p, {high} - d)").alias("q")).agg(F.sum("bytes").alias("total"))


def directory(sums: DataFrame, limit: int, high: int) -> DataFrame:
    """p, depth and shard_bytes for each prefix of ``high`` bits under a prefix that fits.

    A shard is a prefix that fits while the one a bit shorter does not; every prefix below it fits too. A prefix is compared with
    its two extensions only, so no key of the comparison holds more than two rows. Entries that no row uses are listed as well,
    as in any extendible directory.
    """
    fits = sums.where(F.col("total") <= limit)
    shorter = fits.select((F.col("d") + 1).alias("d"), F.col("q").alias("_up"))
    leaves = fits.withColumn("_up", F.expr("shiftright(q, 1)")).join(shorter, ["d", "_up"], "left_anti")
    own = F.expr(f"sequence(shiftleft(q, {high} - d), shiftleft(q + 1, {high} - d) - 1)")
    return leaves.select(F.explode(own).alias("p"), F.col("d").alias("depth"), F.col("total").alias("shard_bytes"))


def assign(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, shard (its hash prefix as a string of bits), depth, shard_bytes and fits, for every row.

    The directory covers a few bits more than an even split needs; only prefixes that still hold too much are looked at in the
    next eight bits, and so on. Rows whose 60 bits are all equal, which are repeats of one row or a single row over the limit,
    cannot be told apart by their hash: they stay together at full depth with fits = false.
    """
    rows, done, low = cut(hashed(docs)), [], 0
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    high = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    while True:
        sums = cut(prefix_sums(rows, low, high))
        placed = rows.withColumn("p", _prefix(high)).join(directory(sums, limit, high), "p", "left")
        if high == BITS:
            own = rows.groupBy("h").agg(F.sum("bytes").alias("own")).withColumnRenamed("h", "p")
            done.append(placed.join(own, "p").select("doc_id", "h", F.coalesce("depth", F.lit(BITS)).alias("depth"),
                                                     F.coalesce("shard_bytes", "own").alias("shard_bytes"), F.col("depth").isNotNull().alias("fits")))
            break
        done.append(placed.where("depth is not null").select("doc_id", "h", "depth", "shard_bytes", F.lit(True).alias("fits")))
        open_rows = placed.where("depth is null").select("doc_id", "h", "bytes")
        if sums.where((F.col("d") == high) & (F.col("total") > limit)).isEmpty():
            break
        rows, low, high = cut(open_rows), high + 1, min(BITS, high + 8)
    every = reduce(DataFrame.unionByName, done)
    return every.select("doc_id", F.expr(f"substring(lpad(bin(h), {BITS}, '0'), 1, depth)").alias("shard"), F.col("depth").cast("long"), "shard_bytes", "fits")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document under a limit of one MiB of text a shard."""
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH r AS (SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS h,
                  coalesce(strlen(text), 0) AS bytes, row_number() OVER () AS r FROM documents),
s AS (SELECT d, h >> ({BITS} - d) AS p, sum(bytes) AS total FROM r, (SELECT unnest(range(0, {BITS + 1})) AS d) GROUP BY 1, 2),
f AS (SELECT r, doc_id, h, bytes, min(d) FILTER (total <= {LIMIT_BYTES}) AS depth
      FROM r JOIN s ON s.p = r.h >> ({BITS} - s.d) GROUP BY 1, 2, 3, 4)
SELECT doc_id, lpad(bin(h), {BITS}, '0')[1:coalesce(depth, {BITS})] AS shard, coalesce(depth, {BITS})::BIGINT AS depth,
       total::BIGINT AS shard_bytes, depth IS NOT NULL AS fits
FROM f JOIN s ON s.d = coalesce(depth, {BITS}) AND s.p = h >> ({BITS} - coalesce(depth, {BITS}))
"""

QUERIES = {"op7_sharding": (op7_sharding, SQL)}

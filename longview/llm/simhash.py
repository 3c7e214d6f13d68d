"""SimHash fingerprints, pigeonhole blocks and the groups that close fingerprints form."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.llm.common import byte_words, map_text, table
from longview.llm.graph import components
from longview.session import cleaned_shuffles, cut

#: A block's fingerprints are compared in chunks of about this many, so that a task's memory has a bound.
CHUNK = 2048
#: Keys of blocks above CHUNK are sent to every task up to this many, joined beyond.
MAX_BROADCAST_KEYS = 100_000
#: Near copies: Jaccard similarity of sets of five-word shingles. Of 256 bits, at most TIGHT differ where that needs no count, and at
#: most LOOSE where it is worth one: at similarity 0.8, 39 differ on average, with a deviation of 6. NEAR of the first 64 for SimHash blocks.
LEAST, NEAR, TIGHT, LOOSE = 0.8, 4, 16, 64
#: Shingles of one chunk of the exact count.
SLOT_BYTES = 1 << 20
#: Prefix shingles of more texts than this come last in the order of shingles.
HEAVY = 16
WIDE = ["v0", "v1", "v2", "v3"]


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words joined by one space; of the whole sequence where it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    ends = [s - 1 for s in starts[size:]] + [len(joined)]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set where it is set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def mix(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash (the finaliser of SplitMix64 over hash + salt)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def shingle_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", size: int = 4, out: str = "fp") -> DataFrame:
    """``keep`` and one 64-bit fingerprint of the text's word shingles, repeats included (null or no words: zero)."""
    return map_text(docs, keep, text, lambda texts: [_longs([majority(shingle_hashes(byte_words(t), size)) for t in texts])],
                    [(out, T.LongType())])


def shingle_sets(docs: DataFrame, keep: list[str], text: str = "text", size: int = 5) -> DataFrame:
    """``keep`` and ``own``, the sorted distinct shingle hashes of every text (null or no words: empty)."""

    def make(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([np.unique(shingle_hashes(byte_words(t), size)).view(np.int64) for t in texts], pa.list_(pa.int64()))]

    return map_text(docs, keep, text, make, [("own", T.ArrayType(T.LongType()))])


def set_node(once: np.ndarray) -> int:
    """A hash of a set of shingles given in order; 0 for none."""
    return xxhash.xxh64_intdigest(once.tobytes(), 42) if len(once) else 0


def set_prints(docs: DataFrame, keep: list[str], text: str = "text", size: int = 5) -> DataFrame:
    """``keep``, ``node`` (see ``set_node``), ``n`` (the size of the text's set of shingles) and ``v0`` to ``v3``, 256 bits over it."""

    def make(texts: list[bytes]) -> list[pa.Array]:
        rows = []
        for t in texts:
            once = np.unique(shingle_hashes(byte_words(t), size))
            rows.append([set_node(once), len(once), *(majority(mix(once, k)) for k in range(1, 5))])
        return [_longs([r[k] for r in rows]) for k in range(6)]

    return map_text(docs, keep, text, make, [(c, T.LongType()) for c in ("node", "n", *WIDE)])


def prefixes(docs: DataFrame, least: float, last: np.ndarray | None = None, text: str = "text", size: int = 5) -> DataFrame:
    """``node`` and ``keys``: the first n - ceil(least * n) + 1 of a text's n shingle hashes.

    Two sets of Jaccard similarity ``least`` or more share one of these whatever the order, as long as all texts use the same one:
    by mixed hash, the hashes ``last`` (sorted) behind all others.
    """

    def make(texts: list[bytes]) -> list[pa.Array]:
        out, nodes = [], []
        for t in texts:
            once = np.unique(shingle_hashes(byte_words(t), size))
            take = len(once) - math.ceil(least * len(once) - 1e-9) + 1 if len(once) else 0
            order = mix(once, 5)
            if last is not None and len(last) and len(once):
                late = last[np.minimum(np.searchsorted(last, once), len(last) - 1)] == once
                out.append(once[np.lexsort((order, late))[:take]].view(np.int64))
            else:
                out.append(once[np.argsort(order)[:take]].view(np.int64))
            nodes.append(set_node(once))
        return [_longs(nodes), pa.array(out, pa.list_(pa.int64()))]

    return map_text(docs, [], text, make, [("node", T.LongType()), ("keys", T.ArrayType(T.LongType()))])


def block_masks(radius: int, n: int) -> list[int]:
    """Bit masks of the block sets of which two fingerprints within ``radius`` share one.

    With radius + s blocks, two fingerprints that differ in at most ``radius`` bits agree on s blocks or more. The smallest s is
    taken whose s blocks hold enough bits that ``n`` even fingerprints would meet about eight at a time; it grows with the input.
    """
    share = 1
    while 64 * share / (radius + share) < math.log2(max(n, 1)) - 3:
        share += 1
    blocks = radius + share
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [sum(one[i] for i in pick) for pick in combinations(range(blocks), share)]


def forest(node: np.ndarray, fp: np.ndarray, verify: np.ndarray | None, radius: int, verify_radius: int) -> list[tuple[int, int]]:
    """Edges that hold together what is linked among these fingerprints: one fewer than the members of each group."""
    left, out = np.arange(len(node)), []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
            if verify is not None and near.any():
                near &= np.bitwise_count(verify[left] ^ verify[i]).sum(axis=1, dtype=np.int64) <= verify_radius
            hit = left[near]
            if len(hit):
                out += [(int(node[i]), int(node[j])) for j in hit]
                frontier += hit.tolist()
                left = left[~near]
    return out


def _edges_of(radius: int, verify: int, verify_radius: int) -> Callable:
    """Walks a partition sorted by (key, slot) and yields the forest of every run; a run may go over Arrow batches."""

    def edges(keys, node, fp, ver) -> list[tuple[int, int]]:
        if not len(keys):
            return []
        cut_at = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.r_[0, cut_at], np.r_[cut_at, len(keys)]
        size, out = ends - starts, []
        two = starts[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        if ver is not None:
            near &= np.bitwise_count(ver[two] ^ ver[two + 1]).sum(axis=1, dtype=np.int64) <= verify_radius
        out += list(zip(node[two[near]].tolist(), node[two[near] + 1].tolist()))
        for a, b in zip(starts[size > 2], ends[size > 2]):
            out += forest(node[a:b], fp[a:b], None if ver is None else ver[a:b], radius, verify_radius)
        return out

    def run(batches):
        rest = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)], axis=1)
            rest = now if rest is None else np.concatenate([rest, now])
            last = np.flatnonzero((rest[:, :2] != rest[-1, :2]).any(axis=1))
            done = last[-1] + 1 if len(last) else 0
            yield from send(rest[:done])
            rest = rest[done:]
        if rest is not None:
            yield from send(rest)

    def send(rows):
        bits = np.ascontiguousarray(rows).view(np.uint64)
        found = edges(rows[:, :2], rows[:, 2], bits[:, 3], bits[:, 4:] if verify else None)
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int, verify: list[str] | None = None, verify_radius: int = 0) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints are close, enough of them that every linked pair is connected.

    ``fps`` has one row for each distinct fingerprint: ``node``, ``fp`` and the ``verify`` columns. Nodes are linked at ``radius``
    or fewer differing bits of ``fp``, and at ``verify_radius`` or fewer over the verify columns together where there are any.
    Rows are dealt out by the block sets they fall in. A block that many fingerprints share is cut into chunks, and each two
    chunks meet in a slot of their own; a slot gives a spanning forest, never all its pairs.
    """
    verify = verify or []
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, fps.count())]
    keyed = fps.select(F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("key"),
                       "node", "fp", *verify)
    hot = cut(keyed.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).alias("parts")))
    n_hot = hot.count()
    slot = F.lit(0).cast("long")
    if n_hot:
        keyed = keyed.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST_KEYS else hot, "key", "left")
        parts = F.coalesce("parts", F.lit(1))
        own = F.pmod(F.xxhash64("node"), parts)
        slot = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)))
    dealt = keyed.select("key", slot.alias("slot"), "node", "fp", *verify).repartition("key", "slot").sortWithinPartitions("key", "slot")
    return dealt.mapInArrow(_edges_of(radius, len(verify), verify_radius), "a long, b long")


def near_groups(docs: DataFrame, radius: int, verify: list[str] | None = None, verify_radius: int = 0) -> DataFrame:
    """``docs`` (with ``fp`` and the verify columns) and ``group``: a long that linked rows share.

    Equal fingerprints become one node before anything is compared, so copies cost one row however many there are. ``docs``
    is read more than once and should be materialised. ``group`` is one node of the group; no row is lost or repeated.
    """
    verify = verify or []
    node = F.xxhash64("fp", *verify) if verify else F.col("fp")
    fps = cut(docs.select(node.alias("node"), "fp", *verify).distinct())
    linked = cut(components(links(fps, radius, verify, verify_radius)))
    return (docs.withColumn("node", node).join(linked, "node", "left")
            .withColumn("group", F.coalesce("component", "node")).drop("node", "component"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document: four-word shingles, links at four bits or fewer.

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows each get their row. A null doc_id
    keeps its row and counts in no component's minimum.
    """
    fps = cut(shingle_fingerprint(table(spark, sf_dir, "documents"), ["doc_id"]))
    groups = near_groups(fps, 4)
    by_fp = groups.groupBy("fp", "group").agg(F.min("doc_id").alias("low"))
    whole = by_fp.groupBy("group").agg(F.min("low").alias("component_id"))
    ids = by_fp.join(whole, "group").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class _Ties:
    """Which nodes a task has tied together so far; an edge inside a tie is told once only."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, node: int) -> int:
        up = self.up
        root = node
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(node, node)) != root:
            up[node], node = root, above
        return root

    def new(self, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for a, b in edges:
            x, y = self.top(a), self.top(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def _runs(batches, keys: int, lists: bool, work: Callable):
    """Walks a partition sorted by its first ``keys`` columns and calls ``work(rows, lists)`` for whole runs of them, many at a time.

    All columns are longs; with ``lists`` the last one has arrays of longs, told unsigned. A run may go over Arrow batches.
    """
    held, own, size = [], [], 0
    for batch in batches:
        plain = batch.num_columns - lists
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(plain)], axis=1))
        if lists:
            column = batch.column(plain)
            at = column.offsets.to_numpy()
            own += np.split(column.flatten().to_numpy().view(np.uint64), at[1:-1] - at[0])
        size += len(held[-1])
        if size < (1 << 15 if not lists else 1 << 10):
            continue
        rows = np.concatenate(held)
        before = np.flatnonzero((rows[:, :keys] != rows[-1, :keys]).any(axis=1))
        done = before[-1] + 1 if len(before) else 0
        if done:
            yield from work(rows[:done], own[:done])
        held, own, size = [rows[done:]], own[done:], len(rows) - done
    if size:
        yield from work(np.concatenate(held), own)


def _each(rows: np.ndarray, keys: int) -> list[tuple[int, int]]:
    """Where the runs of the first columns that hold two rows or more start and end."""
    at = np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1
    starts, ends = np.r_[0, at], np.r_[at, len(rows)]
    return list(zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()))


def _edge_batch(edges: list[tuple[int, int]]):
    if edges:
        both = np.array(edges, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _apart(n: np.ndarray, bits: np.ndarray, least: float) -> Callable:
    """Differing bits of rows i and j; far more than there are where their sizes do not allow the similarity."""

    def apart(i, j):
        d = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=-1, dtype=np.int64)
        return np.where(np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9, d, 1 << 10)

    return apart


def _meeting(radius: int, least: float) -> Callable:
    """Walks a partition sorted by (key, slot) and yields a forest of what is at most ``radius`` bits apart there.

    The forest is one over all slots of the task, so its edges are fewer than its nodes.
    """

    def run(batches):
        ties = _Ties()

        def work(rows, _):
            apart, edges = _apart(rows[:, 3], np.ascontiguousarray(rows[:, 4:]).view(np.uint64), least), []
            for a, b in _each(rows, 2):
                left = np.arange(a, b)
                while len(left) > 1:
                    frontier, left = [left[0]], left[1:]
                    while frontier and len(left):
                        i = frontier.pop()
                        near = apart(i, left) <= radius
                        hit = left[near]
                        if len(hit):
                            edges += ties.new([(int(rows[i, 2]), int(rows[j, 2])) for j in hit])
                            frontier += hit.tolist()
                            left = left[~near]
            yield from _edge_batch(edges)

        yield from _runs(batches, 2, False, work)

    return run


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _counting(tight: int, radius: int, least: float) -> Callable:
    """Walks a partition sorted by (part of the work, slot) and yields the pairs of nodes of unlike groups that are similar, fewer than
    there are groups: at ``tight`` differing bits or fewer, or at ``radius`` or fewer if their shingles say so.

    A slot holds a chunk of nodes, whose pairs are all tried, or two, whose pairs across them are.
    """

    def similar(a, b):
        if not len(a) or not len(b):
            return len(a) == len(b)
        both = shared(a, b)
        return both >= least * (len(a) + len(b) - both) - 1e-9

    def run(batches):
        ties = _Ties()

        def work(rows, own):
            apart, edges = _apart(rows[:, 5], np.ascontiguousarray(rows[:, 6:]).view(np.uint64), least), []
            for a, b in _each(rows, 2):
                group = np.unique([ties.top(int(g)) for g in rows[a:b, 4]], return_inverse=True)[1]
                chunk = rows[a:b, 2]
                two = (chunk != chunk[0]).any()
                for i in range(a, b):
                    if two and chunk[i - a] != chunk[0]:
                        continue
                    others = np.flatnonzero(chunk != chunk[0]) + a if two else np.arange(i + 1, b)
                    others = others[group[others - a] != group[i - a]]
                    if not len(others):
                        continue
                    d = apart(i, others)
                    near = np.flatnonzero(d <= radius)
                    for k in near[np.argsort(d[near], kind="stable")]:
                        j = int(others[k])
                        if group[j - a] != group[i - a] and (d[k] <= tight or similar(own[i], own[j])):
                            group[group == group[j - a]] = group[i - a]
                            if ties.new([(int(rows[i, 4]), int(rows[j, 4]))]):
                                edges.append((int(rows[i, 3]), int(rows[j, 3])))
            yield from _edge_batch(edges)

        yield from _runs(batches, 2, True, work)

    return run


def jaccard_groups(docs: DataFrame, mark: str = "mark", least: float = LEAST, row: str | None = None) -> DataFrame:
    """``mark`` and ``group`` (a long) for every distinct ``mark`` (a hash of ``text``) of ``docs``: texts whose sets of five-word
    shingles have Jaccard similarity ``least`` or more share a group, as do those that a chain of such pairs ties together.

    Equal sets become one node. SimHash comes first, as in op2: fingerprints over the shingles, pigeonhole blocks, Hamming distance
    (at most NEAR of the first 64 bits and TIGHT of all 256, for which a pair under the similarity would have to be four deviations
    off), components. The exact check follows, so that a pair farther apart is not lost: nodes that share a prefix shingle (see
    ``prefixes``) and differ in at most LOOSE bits, four deviations the other way, belong to one part of the work, which a forest
    tells. Shingles that more than HEAVY texts share in their prefixes are put behind all others in a second pass, which changes no
    result, and blocks that stay hot are cut into chunks that meet two by two. In a part, all pairs of unlike groups are tried, their
    shingles counted exactly; a large part is cut into chunks of about SLOT_BYTES. No table of pairs is written. ``row`` is a hash of
    a row of ``docs``; of rows of one text only the first is then read for its shingles.
    """
    row = row or mark
    texts = docs.select(*dict.fromkeys([mark, row]), "text")
    prints = cut(set_prints(texts, [F.col(mark), F.col(row).alias("__row")]).groupBy(mark, "node", "n", *WIDE).agg(F.min("__row").alias("__row")))
    nodes = cut(prints.groupBy("node", "n", *WIDE).agg(F.min("__row").alias("__row")))
    near = cut(components(links(nodes.select("node", F.col("v0").alias("fp"), *WIDE), NEAR, WIDE, TIGHT)))

    def keys(last=None):
        keyed = prefixes(texts, least, last).select(F.explode("keys").alias("key"), "node")
        return keyed, cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1"))

    # Not written: making the keys again costs less disk than holding them, and copies only make counts larger.
    keyed, common = keys()
    heavy = [r[0] for r in common.where(F.col("count") > HEAVY).orderBy(F.desc("count"), "key").limit(MAX_BROADCAST_KEYS).collect()]
    if heavy:
        keyed, common = keys(np.sort(np.array(heavy, np.int64).view(np.uint64)))

    def slots(parts):
        own = F.pmod(F.xxhash64("node"), parts)
        return own, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)))

    met = keyed.join(common, "key").select("key", slots(F.ceil(F.col("count") / (4 * CHUNK)))[1].alias("slot"), "node").distinct()
    dealt = met.join(nodes.select("node", "n", *WIDE), "node").select("key", "slot", "node", "n", *WIDE).repartition("key", "slot").sortWithinPartitions("key", "slot")
    loose = cut(components(dealt.mapInArrow(_meeting(LOOSE, least), "a long, b long")))
    members = cut(loose.withColumnRenamed("component", "work").join(nodes, "node").join(near, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component"))
    # What SimHash has tied together whole needs no count.
    sized = members.groupBy("work").agg(F.ceil(F.sum("n") * 8 / SLOT_BYTES).alias("parts"), F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high")
    own, slot = slots(F.greatest("parts", F.lit(1).cast("long")))
    asked = members.join(sized, "work").select("__row", "node", "work", "parts", "of", "n", *WIDE)
    sets = shingle_sets(texts.withColumn("__row", F.col(row)).join(asked, "__row"), asked.columns)
    held = sets.select("work", slot.alias("slot"), own.alias("chunk"), "node", "of", "n", *WIDE, "own").repartition("work", "slot").sortWithinPartitions("work", "slot")
    passed = held.mapInArrow(_counting(TIGHT, LOOSE, least), "a long, b long")
    group = components(passed.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    whole = nodes.select("node").join(group, "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    return prints.join(whole, "node").select(mark, "group")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one of each group of near copies stays: the one with the smallest doc_id.

    Groups are those of ``jaccard_groups``. Rows of equal doc_id are told apart by their text; a row repeated with both equal
    counts as one document and stays once. A null doc_id sorts first. Texts without a word (null, empty) are copies of each other.
    """
    del sf_dir
    with cleaned_shuffles(spark):
        known = docs.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
        groups = cut(jaccard_groups(known.withColumn("__id", F.xxhash64("doc_id", "__mark")), "__mark", row="__id"))
    stay = known.select("doc_id", "__mark").join(groups, "__mark").groupBy("group").agg(F.min(F.struct("doc_id", "__mark")).alias("first")).select(
        F.col("first.doc_id").alias("__id"), F.col("first.__mark").alias("__own"))
    kept = known.join(stay, known["doc_id"].eqNullSafe(stay["__id"]) & (known["__mark"] == stay["__own"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__mark"]).drop("__mark")


QUERIES = {"op2_simhash_dedup": (op2_simhash_dedup, None)}

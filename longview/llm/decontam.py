"""Benchmark items inside documents: item-sized windows by SimHash, then exact similarity of weighted shingles."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import small_batches, table
from longview.llm.simhash import mix
from longview.session import cut

SHINGLE, MIN_SIMILARITY = 5, 0.8
#: Fingerprints of texts at the least similarity differ in 10 bits on average, in 18 or fewer nearly always.
RADIUS = 18
#: Text of the benchmark that one pass sends to every task; a larger benchmark takes several passes.
SLICE_BYTES = 8 << 20
#: Bytes of words as they are compared (A-Z lower-cased), all others as blanks.
LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
FOUND = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"
#: Most positions of one document that are looked at in one step.
STEP = 1 << 16
#: A task forgets the words it has hashed when they are more than this.
MAX_WORDS = 200_000
#: Most pairs of windows and items that one Hamming block may compare in one step.
PAIRS = 1 << 20


class _Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def _words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def _mixed(own: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, mixed from those of its words in order."""
    n = len(own) - size + 1
    hashes = mix(own[:n], 1)
    with np.errstate(over="ignore"):
        for k in range(1, size):
            hashes = mix(hashes + own[k : k + n], 1)
    return hashes


def _shingles(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of every run of ``size`` words; the weight is the run's number of word bytes."""
    if len(words) < max(size, 1):
        return np.empty(0, np.uint64), np.empty(0, np.float64)
    total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return _mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), size), (total[size:] - total[:-size]).astype(np.float64)


def _fingerprints(hashes: np.ndarray, weights: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the ``n`` shingles from each of the positions ``at``, each shingle counting by its weight."""
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), STEP):
        some = at[i : i + STEP]
        low, high = some[0], some[-1] + n
        signs = np.unpackbits(np.ascontiguousarray(hashes[low:high]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * 2.0 - 1
        total = np.concatenate([np.zeros((1, 64)), np.cumsum(signs * weights[low:high, None], axis=0)])
        ones = total[some - low + n] - total[some - low] > 1e-6
        out[i : i + STEP] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _similarity(a: Counter, b: Counter, weight: dict) -> float:
    both = sum(min(n, b[h]) * weight[h] for h, n in a.items() if h in b)
    return both / (sum(n * weight[h] for h, n in a.items()) + sum(n * weight[h] for h, n in b.items()) - both)


class Items:
    """One slice of the benchmark: fingerprints by item length with an index over their Hamming blocks, and all its shingles."""

    def __init__(self, rows: list[tuple[int | None, bytes]], radius: int):
        self.radius, self.blocks = radius, radius + 1
        self.edges = [64 * i // self.blocks for i in range(self.blocks + 1)]
        by_length: dict[int, list] = {}
        for item_id, text in rows:
            words = _words(text)
            if words:
                by_length.setdefault(len(words), []).append((item_id, words))
        self.known: dict[int, np.ndarray] = {}  # by shingle size
        self.maybe: dict[int, np.ndarray] = {}  # by shingle size: whether any known shingle's hash starts with these 20 bits
        self.lengths = []  # (words, shingle size, shingles, ids, fingerprints, block indexes, shingle counts, weights)
        for length, items in sorted(by_length.items()):
            size = min(SHINGLE, length)
            pairs = [_shingles(words, size) for _, words in items]
            fps = np.concatenate([_fingerprints(h, w, np.zeros(1, np.int64), len(h)) for h, w in pairs])
            keys = self.keys(fps).ravel()
            order = np.argsort(keys, kind="stable")
            index = (keys[order], order % len(fps))
            self.lengths.append((length, size, length - size + 1, [i for i, _ in items], fps, index,
                                 [Counter(h.tolist()) for h, _ in pairs], [dict(zip(h.tolist(), w.tolist())) for h, w in pairs]))
            self.known[size] = np.union1d(self.known.get(size, np.empty(0, np.uint64)), np.concatenate([h for h, _ in pairs]))
        for size, known in self.known.items():
            self.maybe[size] = np.zeros(1 << 20, bool)
            self.maybe[size][known >> np.uint64(44)] = True

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """Every block of every fingerprint with the block's number, block by block."""
        out = np.empty((self.blocks, len(fps)), np.uint64)
        for k in range(self.blocks):
            width = self.edges[k + 1] - self.edges[k]
            out[k] = (fps >> np.uint64(self.edges[k]) & np.uint64((1 << width) - 1)) * np.uint64(self.blocks) + np.uint64(k)
        return out

    def near(self, fps: np.ndarray, own: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
        """(distance, window, item) of every window and item within the radius: they agree on one of radius + 1 blocks at least."""
        known, items = index
        mine = self.keys(fps).ravel()
        low, high = np.searchsorted(known, mine, "left"), np.searchsorted(known, mine, "right")
        n = high - low
        met = np.repeat(np.arange(len(mine)) % len(fps), n) * len(own) + items[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
        met = np.unique(met)
        window, item = met // len(own), met % len(own)
        distance = np.bitwise_count(fps[window] ^ own[item])
        close = distance <= self.radius
        return list(zip(distance[close].tolist(), window[close].tolist(), item[close].tolist()))

    def shared(self, texts: list[bytes], hashes: _Hashes) -> dict[int, dict[int, tuple]]:
        """By text and shingle size, where a text has a shingle of the benchmark: its hashes and weights, and sums of all weights and
        of those in such shingles. All texts are worked on as one row of words."""
        words = [_words(t) for t in texts]
        size_of = np.array([len(w) for w in words])
        ends = np.cumsum(size_of)
        flat = [w for own in words for w in own]
        own = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))])
        found: dict[int, dict[int, tuple]] = {}
        for size, known in self.known.items():
            if len(flat) < size:
                continue
            made = _mixed(own, size)
            spot = np.flatnonzero(self.maybe[size][made >> np.uint64(44)])
            spot = spot[known[np.minimum(np.searchsorted(known, made[spot]), len(known) - 1)] == made[spot]]
            text = np.searchsorted(ends, spot, side="right")
            inside = spot + size <= ends[text]
            spot, text = spot[inside], text[inside]
            for i in np.unique(text).tolist():
                a, b = int(ends[i] - size_of[i]), int(ends[i]) - size + 1
                weights = (total[a + size : b + size] - total[a:b]).astype(np.float64)
                hit = np.zeros(b - a)
                hit[spot[text == i] - a] = 1
                found.setdefault(i, {})[size] = (made[a:b], weights, np.concatenate([[0], np.cumsum(weights)]), np.concatenate([[0], np.cumsum(weights * hit)]))
        return found

    def search(self, seen: dict[int, tuple], least: float) -> list[tuple]:
        """(item, start, words, distance, similarity) for each item found in a text (see ``shared``), at its closest window that passes."""
        out = []
        for _, size, n, ids, own, index, counts, item_weights in self.lengths:
            if size not in seen:
                continue
            hashes, weights, every, hits = seen[size]
            n = min(n, len(hashes))  # a document shorter than the item is one window
            at = np.flatnonzero(hits[n:] - hits[:-n] >= least * (every[n:] - every[:-n]) - 1e-6)
            if not len(at):
                continue
            fps, step = _fingerprints(hashes, weights, at, n), max(1, PAIRS // len(own))
            close = [(distance, i + window, item) for i in range(0, len(at), step) for distance, window, item in self.near(fps[i : i + step], own, index)]
            done = set()
            for distance, window, item in sorted(close):
                if item in done:
                    continue
                a = int(at[window])
                part = hashes[a : a + n].tolist()
                similarity = _similarity(Counter(part), counts[item], item_weights[item] | dict(zip(part, weights[a : a + n].tolist())))
                if similarity >= least:
                    done.add(item)
                    out.append((ids[item], a, n + size - 1, distance, similarity))
        return out


def matches(docs: DataFrame, items: DataFrame, radius: int = RADIUS, least: float = MIN_SIMILARITY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row for each benchmark item found in a document: doc_id, item_id, start_word, n_words, distance, similarity.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and all other characters; shingles have five words, or all of
    a shorter item's. Every window of an item's length is a candidate, but one of which less than ``least`` of the weight
    is in shingles of the benchmark cannot reach that similarity with any item and gets no fingerprint. Windows and items of
    one length meet in Hamming blocks, radius + 1 of them, so that none within ``radius`` bits is missed, and are then verified:
    shared weight over joint weight of their shingles, repeats counted, must be ``least`` or more. Each pair is reported once, at
    the closest window that passes (ties: the first).

    ``docs`` needs doc_id and text, ``items`` item_id and text. Nulls are empty texts; texts without words match nothing; equal
    items are reported each; repeated documents too. The benchmark goes to the tasks in slices of ``slice_bytes`` of text, so
    what a task holds has a bound for a benchmark of any size.
    """
    small_batches(docs.sparkSession)
    sized = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(total / slice_bytes))
    parts = []
    for k in range(slices):
        own = sized.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).select("item_id", F.col("text").cast("binary")).orderBy("item_id", "text").collect()
        # Plain values, not the object: executors need no installed copy of this module to read them.
        index = docs.sparkSession.sparkContext.broadcast(vars(Items([(r[0], bytes(r[1])) for r in own], radius)))

        def run(batches, index=index):
            held = Items.__new__(Items)
            held.__dict__, hashes = index.value, _Hashes()
            for batch in batches:
                ids, rows = batch.column(0), []
                if len(hashes) > MAX_WORDS:
                    hashes.clear()
                for i, seen in sorted(held.shared(batch.column(1).to_pylist(), hashes).items()):
                    rows += [(ids[i].as_py(), *m) for m in held.search(seen, least)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=[f.split()[0] for f in FOUND.split(", ")])

        src = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        found = src.mapInArrow(run, FOUND)
        parts.append(cut(found) if slices > 1 else found)
    return reduce(DataFrame.unionByName, parts)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, over all documents."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; a null doc_id is compared as a value.

    Rows are dropped by doc_id and text, so a clean text that shares its id with another stays.
    """
    known = docs.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    # The text's hash rides along as the id: one pass over the texts, and no second key to carry.
    found = matches(known.select(F.col("__mark").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = cut(found.select(F.col("doc_id").alias("__mark")).distinct())
    return known.join(bad, "__mark", "left_anti").select(*docs.columns)


QUERIES = {"op10_decontamination": (op10_decontamination, None)}

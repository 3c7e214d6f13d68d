"""Alignment of two tokenizers over the same bytes, and how often their tokens are linked in the corpus.

All tokens of both sides are sorted by where they start; the running maximum of their ends is carried along, and a group ends where
the next start reaches it. Inside a group every token of one side is linked with every token of the other.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.llm.common import small_batches, table
from longview.session import cut

#: Folder of the public tokenizers' files; the driver reads them and sends them to the tasks (about four MB).
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# How byte-level vocabularies cut a text before merging, and the entry that no text gives.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<|endoftext|>",)
#: A pair is a * B_IDS + b.
B_IDS = 1 << 16
#: This many of the most frequent pairs are sent to every task; all others are joined.
HOT_PAIRS = 100_000
#: Groups of more links than this are counted by distinct ids before they are expanded.
WIDE_LINKS = 1024
#: Texts of about this many bytes are aligned at a time; a longer one by itself.
CHUNK_BYTES = 1 << 20


class Tokenizers:
    """Both tokenizers and, by id, their tokens' bytes."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        import tiktoken

        model, own = json.loads(a)["model"], {c: i for i, c in enumerate(_byte_letters())}
        merged = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if any(model["vocab"][t] != len(own) + i for i, t in enumerate(merged)):
            raise ValueError("the first tokenizer's merges must be in the order of its ids")
        ranks = {bytes(own[c] for c in t): i for t, i in model["vocab"].items() if t not in SPECIAL}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_file, self.slow = a, None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes)]

    def encode_a(self, text: str) -> list[int]:
        """Ids by the quick encoder; where its patterns give up (a run of white space of about a million), by the file's own library."""
        try:
            return self.a.encode_ordinary(text)
        except BaseException as e:  # a panic is no Exception
            if type(e).__name__ != "PanicException":
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.a_file)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for every text; none where the text is empty or either side's bytes are not the blank and the text."""
        full = [i for i, t in enumerate(texts) if t]
        ids_a = [self.encode_a(" " + texts[i]) for i in full]
        ids_b = self.b.encode([texts[i] for i in full], num_threads=1)
        none = np.empty(0, np.int64)
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        for i, a, b in zip(full, ids_a, ids_b):
            want = (" " + texts[i]).encode()
            if b"".join([self.a_bytes[t] for t in a]) == want and b"".join([self.b_bytes[t] for t in b]) == want:
                out_a[i], out_b[i] = np.array(a, np.int64), np.array(b, np.int64)
        return out_a, out_b


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for every byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    later = iter(range(0x100, 0x200))
    return [chr(i) if i in prints else chr(next(later)) for i in range(256)]


@lru_cache(maxsize=2)
def _loaded(a: str, b: bytes) -> Tokenizers:
    return Tokenizers(a, b)


@lru_cache(maxsize=1)
def written_ids() -> list[str]:
    """Every id with the mark that may follow it: side and mark, then id, as ``align`` looks them up."""
    return [f"{i}{mark}" for _ in range(2) for mark in ",|;" for i in range(B_IDS)]


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the tokens by start (side A first) and each one's group in that order, from 0."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for every n, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _count(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights by distinct key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else np.empty(0, np.int64)


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order, and how often each occurs."""
    keys, n = _count(group * B_IDS + ids, np.ones(len(ids), np.int64))
    return keys // B_IDS, keys % B_IDS, n


def expand(groups: int, group_a, ids_a, group_b, ids_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (group, pair) with its number of links, not yet summed; ids come in the order of their groups.

    A group of many links is reduced to its distinct ids first, so a long stretch without a shared boundary costs its distinct
    pairs, not all its occurrences.
    """
    many = np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups) > WIDE_LINKS
    found = []
    for wide in (False, True):
        a, b = many[group_a] == wide, many[group_b] == wide
        if wide:
            ga, ia, na = _distinct(group_a[a], ids_a[a])
            gb, ib, nb = _distinct(group_b[b], ids_b[b])
        else:
            ga, ia, na, gb, ib, nb = group_a[a], ids_a[a], np.ones(a.sum(), np.int64), group_b[b], ids_b[b], np.ones(b.sum(), np.int64)
        of_b = np.bincount(gb, minlength=groups)
        first_b = np.cumsum(of_b) - of_b
        times = of_b[ga]
        at = np.repeat(first_b[ga], times) + _ranges(times)
        found.append((np.repeat(ga, times), np.repeat(ia, times) * B_IDS + ib[at], np.repeat(na, times) * nb[at]))
    return tuple(np.concatenate(x) for x in zip(*found))


def align(out_a: list[np.ndarray], out_b: list[np.ndarray], sizes: list[np.ndarray], texts: list[str]) -> dict[str, list]:
    """For each text its counts, the digest of its groups, and its distinct pairs with their numbers of links."""
    n_a, n_b = np.array([len(x) for x in out_a]), np.array([len(x) for x in out_b])
    ids = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b)]
    ends = [np.cumsum(sizes[s][ids[s]]) for s in (0, 1)]
    # Texts lie one after another on both sides alike, so no group goes over a text's end.
    side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
    every, end = np.concatenate(ids), np.concatenate(ends)
    start = end - np.concatenate([sizes[s][ids[s]] for s in (0, 1)])
    order, group = coalesce(start, end, side)
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in (n_a, n_b)])[order]
    groups = int(group[-1]) + 1 if len(group) else 0
    row_of = np.zeros(groups, np.int64)
    row_of[group] = row
    own_side, own_id = side[order], every[order]
    of_a, of_b = own_side == 0, own_side == 1
    found, pairs, n = expand(groups, group[of_a], own_id[of_a], group[of_b], own_id[of_b])
    # At most 2**15 texts at a time, so a text's number and a pair fit in a long.
    keys, n = _count(row_of[found] << 40 | pairs, n)
    text_of, pairs = keys >> 40, keys & (1 << 40) - 1
    bounds = np.searchsorted(text_of, np.arange(len(out_a) + 1))
    by_text = np.searchsorted(row_of, np.arange(len(out_a) + 1))
    # In a group the A ids come first; the mark behind each token says what follows it.
    layout = np.lexsort((start[order], own_side, group))
    g, s = group[layout], own_side[layout]
    mark = np.where(np.r_[g[1:] != g[:-1], True], 2, np.where(np.r_[s[1:] != s[:-1], True], 1, 0)) if len(g) else np.empty(0, np.int64)
    token_bounds = np.searchsorted(row[layout], np.arange(len(out_a) + 1))
    written = list(map(texts.__getitem__, ((s * 3 + mark) * B_IDS + own_id[layout]).tolist()))
    digests, sums = [], []
    for i in range(len(out_a)):
        a, b = token_bounds[i], token_bounds[i + 1]
        text = "".join(written[a:b])[:-1]
        digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        sums.append(int(n[bounds[i] : bounds[i + 1]].sum()))
    return {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": np.diff(by_text).tolist(), "n_links": sums, "groups_sha256": digests,
            "pairs": [pairs[bounds[i] : bounds[i + 1]] for i in range(len(out_a))], "links": [n[bounds[i] : bounds[i + 1]] for i in range(len(out_a))]}


FIELDS = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType()),
          ("pairs", T.ArrayType(T.LongType())), ("links", T.ArrayType(T.LongType()))]


def aligned(docs: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``keep`` and the alignment of every text: token and group counts, links, groups_sha256, and its distinct pairs with their links.

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros, '' and empty arrays.
    """
    small_batches(docs.sparkSession)
    with open(f"{folder}/{a_file}", encoding="utf-8") as f, open(f"{folder}/{b_file}", "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(n, t) for n, t in FIELDS)])
    types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2

    def chunks(texts):
        first, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > CHUNK_BYTES:
                yield first, i
                first, held = i, 0
            held += len(t)
        yield first, len(texts)

    def run(batches):
        both = _loaded(*sent.value)
        numbers = written_ids()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in chunks(texts):
                made = align(*both.encode(texts[a:b]), both.sizes, numbers)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *(pa.array(made[f], t) for (f, _), t in zip(FIELDS, types))],
                                                 names=schema.names)

    return src.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and n: how many rows hold each pair; added up before the shuffle."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def with_counts(rows: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``rows`` (see ``aligned``, materialised) with n_best and count_sum instead of pairs and links.

    The most frequent pairs, which hold most links, are looked up in the task; so is the highest count of each A id, of which there
    are no more than the vocabulary has. The rest is joined by pair: such a pair is in a hot_pairs-th of all rows' pairs at most, so
    no key is hot, and its sums come back by row. Both ways are taken at every size; together they cover all pairs.
    """
    counts = cut(pair_counts(rows))
    best = counts.groupBy(F.floor(F.col("pair") / B_IDS).alias("a")).agg(F.max("n").alias("n")).collect()
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).collect()
    highest = np.zeros(max([r["a"] for r in best], default=0) + 1, np.int64)
    for r in best:
        highest[r["a"]] = r["n"]
    known = np.array(sorted((r["pair"], r["n"]) for r in hot), np.int64).reshape(-1, 2)
    sent = rows.sparkSession.sparkContext.broadcast((known[:, 0].copy(), known[:, 1].copy(), highest))
    rest = [c for c in rows.columns if c not in ("pairs", "links")]
    src = rows.select(*rest, F.monotonically_increasing_id().alias("__row"), "pairs", "links")
    schema = T.StructType([*src.schema.fields[:-2], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           T.StructField("left", T.ArrayType(T.LongType())), T.StructField("left_links", T.ArrayType(T.LongType()))])

    def run(batches):
        keys, n, top = sent.value
        for batch in batches:
            pairs, links = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            size = np.diff(pairs.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            p, w = pairs.flatten().to_numpy(), links.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, p), max(len(keys) - 1, 0))
            hit = keys[at] == p if len(keys) else np.zeros(len(p), bool)
            count = np.where(hit, n[at], 0) if len(keys) else np.zeros(len(p), np.int64)
            best = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(best, row[hit], np.where(count == top[p // B_IDS], w, 0)[hit])
            np.add.at(total, row, count * w)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))], pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], pa.int64())) for x in (p, w)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(best), pa.array(total), *left], names=schema.names)

    first = cut(src.mapInArrow(run, schema))
    top = counts.withColumn("a", F.floor(F.col("pair") / B_IDS)).join(
        F.broadcast(counts.groupBy(F.floor(F.col("pair") / B_IDS).alias("a")).agg(F.max("n").alias("top"))), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("is_top"))
    left = first.select("__row", F.explode(F.arrays_zip("left", "left_links")).alias("p")).select("__row", F.col("p.left").alias("pair"), F.col("p.left_links").alias("w"))
    more = left.join(top, "pair").groupBy("__row").agg(F.sum(F.when(F.col("is_top"), F.col("w")).otherwise(0)).alias("__best"), F.sum(F.col("n") * F.col("w")).alias("__sum"))
    return first.join(more, "__row", "left").select(*rest, (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
                                                    (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    rows = cut(aligned(table(spark, sf_dir, "documents"), ["doc_id"]))
    return with_counts(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_cross_tokenizer_alignment": (op12_cross_tokenizer_alignment, None)}

"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from longview.llm.common import byte_words, small_batches, table
from longview.session import cleaned_shuffles, cut

ORDER, PROBES, BASE = 2, 6, 1.5
#: Bits for each entry: with PROBES hash functions, half of the bits are then set.
BITS_PER_ENTRY = PROBES / math.log(2)
#: A model up to this size is sent to every task; a larger one is joined.
MAX_BROADCAST_BYTES = 192 << 20
#: Text of one step of counting, of one step of probing (which holds the model besides), and of one segment of the model.
STEP_BYTES, PROBE_BYTES, SEGMENT_BYTES = 2 << 20, 1 << 20, 1 << 20
#: Text of one chunk that asks a joined model, and segments (a power of two) that count and reply in one go.
CHUNK_BYTES, SEGMENTS_A_BUCKET = 4 << 20, 8
SCORES = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
FACTOR, MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log of the count to BASE); zero for zero."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def least_of(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level."""
    return np.where(level > 0, np.ceil(BASE ** (level - 1.0) - 1e-9), 0.0)


def most_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.ceil(BASE ** np.asarray(level, np.float64) - 1e-9) - 1, 0.0)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Tokens:
    """The tokens of some texts, each text closed by one end token; hashes of the n-grams that end at each token."""

    def __init__(self, texts: list[bytes]):
        words, lengths = [], []
        for t in texts:
            own = byte_words(t)
            own.append(b"")  # the end; no word is empty
            words += own
            lengths.append(len(own))
        self._lay(*pd.factorize(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))), np.array(lengths, np.int64))

    def _lay(self, codes: np.ndarray, words: np.ndarray, n: np.ndarray) -> Tokens:
        self.codes, self.words, self.n = codes, words, n
        self.doc = np.repeat(np.arange(len(n)), n)
        self.pos = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
        self.grams = [words[codes]]
        return self

    def packed(self) -> tuple[bytes, bytes]:
        """The words' hashes, and each token's place among them, by byte planes."""
        return self.words.tobytes(), pa.compress(np.ascontiguousarray(self.codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)

    @classmethod
    def unpacked(cls, words: bytes, codes: bytes, n: np.ndarray) -> Tokens:
        planes = np.frombuffer(pa.decompress(codes, 4 * int(n.sum()), "zstd", asbytes=True), np.uint8)
        return cls.__new__(cls)._lay(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), np.frombuffer(words, np.uint64), n)

    def of(self, order: int) -> np.ndarray:
        while len(self.grams) < order:
            before, out = self.grams[-1], np.zeros(len(self.doc), np.uint64)
            with np.errstate(over="ignore"):
                out[1:] = _mix(before[:-1] * FACTOR + self.grams[0][1:] + np.uint64(len(self.grams)))
            self.grams.append(out)
        return self.grams[order - 1]


def _steps(texts: pa.Array | list[bytes], most: int):
    """Runs of texts of about ``most`` bytes; of an Arrow column only one run at a time becomes Python values."""
    some, size = [], 0
    for t in texts:
        t = t if isinstance(t, bytes) else t.as_py()
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending, by sorting (of values alone NumPy makes a hash table, which takes many times as long)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _slices(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the rows of ``x``, from each end to the next."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * (x.nbytes // max(1, len(x)))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _blocks(grams: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Ascending ``grams`` by bucket (their bits from ``shift`` on): the buckets, where each ends, and steps from one n-gram to the next.

    Six low bytes of a step apart from two high ones, which are zeros almost always and vanish when shuffle files are compressed.
    """
    bucket = grams >> np.uint64(shift)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(grams) else np.empty(0, np.int64)
    step = np.diff(grams, prepend=np.uint64(0)).astype("<u8")
    step[first] = grams[first] - (bucket[first] << np.uint64(shift))
    ends, raw = np.append(first, len(grams)), step.view(np.uint8).reshape(-1, 8)
    return bucket[first].view(np.int64), ends, [_slices(raw[:, :6], ends), _slices(raw[:, 6:], ends)]


def _grams(rows: pa.Table, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some blocks one after the other, and the number in each."""
    low, high = (rows.column(c).to_pylist() for c in ("low", "high"))
    n = np.fromiter(map(len, low), np.int64, len(low)) // 6
    raw = np.empty((int(n.sum()), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(low), np.uint8).reshape(-1, 6)
    raw[:, 6:] = np.frombuffer(b"".join(high), np.uint8).reshape(-1, 2)
    step = raw.view("<u8").ravel()
    at, total = np.cumsum(n) - n, np.cumsum(step, dtype=np.uint64)
    return total + np.repeat((rows.column("bucket").to_numpy().view(np.uint64) << np.uint64(shift)) - total[at] + step[at], n), n


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves remainder 2 by 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _spread(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The high half of a hash, scaled to 0 .. bits - 1 (a segment has under 2**32 bits)."""
    return (x >> np.uint64(32)) * bits >> np.uint64(32)


def _where(gram: np.ndarray, level: int, bits: np.ndarray):
    """The PROBES bit positions of (gram, level) in segments of ``bits`` bits."""
    a = _mix(gram + np.uint64(level * int(FACTOR) & MASK))
    b = _mix(a ^ FACTOR) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(PROBES):
            yield _spread(a + np.uint64(j) * b, bits)


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, or in 64 where one needs them."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)


def _segment(rows: pa.Table) -> pa.Table:
    """One segment: exact counts of its words, and the filter of its longer n-grams with every level up to their own."""
    order, gram, n = (rows.column(c).to_numpy() for c in ("o", "g", "n"))
    one = order == 1
    by = np.argsort(gram[one].view(np.uint64))
    long, level = gram[~one].view(np.uint64), level_of(n[~one])
    size = max(8, int(level.sum() * BITS_PER_ENTRY) // 8 * 8 + 8)
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in _where(long[level >= q], q, np.uint64(size)):
            bits[at] = 1
    return pa.table({"seg": rows.column("seg")[:1], "size": pa.array([size], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
                     "words": pa.array([gram[one][by].tobytes()], pa.binary()), "counts": pa.array([_small(n[one][by]).tobytes()], pa.binary()),
                     "tokens": pa.array([int(n[one].sum())], pa.int64()), "distinct": pa.array([int(one.sum())], pa.int64())})


class Held:
    """Segments of the model in a task: word counts and n-gram levels by probing."""

    def __init__(self, rows: dict):
        self.__dict__.update(rows)

    def counts(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        by, out = np.argsort(words), np.empty(len(words), np.int64)  # in ascending order, neighbours are found close together
        asked = words[by]
        at = np.minimum(np.searchsorted(self.words, asked), len(self.words) - 1)
        out[by] = np.where(self.words[at] == asked, self.n[at], 0)
        return out

    def word_counts(self, tokens: Tokens) -> np.ndarray:
        """Of each token, the count of its word."""
        return self.counts(tokens.words)[tokens.codes]

    def levels_at(self, tokens: Tokens, k: int, at: np.ndarray) -> np.ndarray:
        """The levels of the n-grams of ``k`` tokens that end at some places."""
        codes, distinct = pd.factorize(tokens.of(k)[at])
        return self.levels(distinct)[codes]

    def levels(self, gram: np.ndarray) -> np.ndarray:
        """Levels are probed from one on until a probe fails; each probe looks at what the one before has left."""
        out = np.zeros(len(gram), np.int64)
        seg = (gram >> np.uint64(self.shift)).astype(np.int64)
        size, start = self.size[seg], self.start[seg]
        alive, level = np.flatnonzero(size > 0), 0
        while len(alive):
            level += 1
            a = _mix(gram[alive] + np.uint64(level * int(FACTOR) & MASK))
            step, bits, byte = _mix(a ^ FACTOR) | np.uint64(1), size[alive], start[alive]
            for j in range(PROBES):
                with np.errstate(over="ignore"):
                    at = _spread(a + np.uint64(j) * step, bits)
                is_set = (self.bits[byte + (at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).view(bool)
                if j == PROBES - 1:
                    alive = alive[is_set]
                else:
                    alive, a, step, bits, byte = alive[is_set], a[is_set], step[is_set], bits[is_set], byte[is_set]
            out[alive] = level
        return out


def _hold(rows: list, segments: int) -> dict:
    """Plain arrays of some segments (seg, size, bits, words, counts); sizes of absent ones are zero."""
    size, start, at = np.zeros(segments, np.uint64), np.zeros(segments, np.int64), 0
    for r in rows:
        size[r["seg"]], start[r["seg"]] = r["size"], at
        at += len(r["bits"])
    words = np.frombuffer(b"".join(r["words"] for r in rows), np.uint64)
    n = _small(np.concatenate([np.frombuffer(r["counts"], f"u{8 * len(r['counts']) // max(1, len(r['words']))}") for r in rows if r["words"]] or [np.empty(0, np.uint32)]))
    order = np.argsort(words, kind="stable")
    return {"size": size, "start": start, "bits": np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8), "words": words[order],
            "n": n[order], "shift": 64 - int(math.log2(segments))}


def _longer(tokens: Tokens, order: int) -> np.ndarray:
    """The n-grams of two to ``order`` tokens, order by order."""
    return np.concatenate([np.empty(0, np.uint64), *(tokens.of(k)[tokens.pos >= k - 1] for k in range(2, order + 1))])


class Values:
    """The same answers for the tokens of one chunk, from replies to its ascending words and its ascending distinct longer n-grams."""

    def __init__(self, tokens: Tokens, order: int, n: np.ndarray, level: np.ndarray):
        self.n, self.level = np.empty(len(n), np.int64), {}
        self.n[np.argsort(tokens.words)] = n
        level, at = level[np.unique(_longer(tokens, order), return_inverse=True)[1]], 0
        for k in range(2, order + 1):
            own = np.flatnonzero(tokens.pos >= k - 1)
            self.level[k] = np.zeros(len(tokens.pos), np.int64)
            self.level[k][own] = level[at:at + len(own)]
            at += len(own)

    def word_counts(self, tokens: Tokens) -> np.ndarray:
        return self.n[tokens.codes]

    def levels_at(self, tokens: Tokens, k: int, at: np.ndarray) -> np.ndarray:
        return self.level[k][at]


def _as_stream(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(rows)
    return out.getvalue().to_pybytes()


def _read(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def _bucket_shift(segments: int) -> int:
    """An n-gram's bucket is what lies above these bits of its hash: SEGMENTS_A_BUCKET segments side by side."""
    return 64 - int(math.log2(segments)) + int(math.log2(SEGMENTS_A_BUCKET))


def _chunks(docs: DataFrame, text: str, learnt: Column) -> DataFrame:
    """The tokens and the other columns of runs of rows of about CHUNK_BYTES of text; learnt rows have odd chunk numbers, the others even ones."""
    src = docs.select(*(c for c in docs.columns if c != text), learnt.alias("__learnt"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))

    def run(batches):
        held, size, k = {True: [], False: []}, {True: 0, False: 0}, 0
        first = TaskContext.get().partitionId() << 32

        def chunk(learnt):
            rows = pa.Table.from_batches(held[learnt])
            tokens = Tokens(rows.column("__text").to_pylist())
            rest = _as_stream(rows.drop_columns(["__learnt", "__text"]).append_column("__n", pa.array(tokens.n)))
            held[learnt], size[learnt] = [], 0
            words, codes = tokens.packed()
            return pa.RecordBatch.from_pydict({"chunk": [first + 2 * k + learnt], "rest": [rest], "words": [words], "codes": [codes]})

        for batch in batches:
            for learnt in (True, False):
                part = batch.filter(batch.column("__learnt") if learnt else pc.invert(batch.column("__learnt")))
                ends, at = np.cumsum(pc.binary_length(part.column("__text")).to_numpy(zero_copy_only=False) + 8, dtype=np.int64), 0  # an empty text has its end
                while at < part.num_rows:
                    done = ends[at - 1] if at else 0
                    to = min(int(np.searchsorted(ends, done + CHUNK_BYTES - size[learnt])) + 1, part.num_rows)
                    held[learnt].append(part.slice(at, to - at))
                    size[learnt] += int(ends[to - 1] - done)
                    at = to
                    if size[learnt] >= CHUNK_BYTES:
                        yield chunk(learnt)
                        k += 1
        for learnt in (True, False):
            if held[learnt]:
                yield chunk(learnt)
                k += 1

    return src.mapInArrow(run, "chunk long, rest binary, words binary, codes binary")


class Model:
    """Segments of the filter and the word counts as a table; token totals; weights of the orders by history level."""

    def __init__(self, segments: DataFrame, count: int, order: int, max_broadcast: int):
        self.segments, self.count, self.order = segments, count, order
        tokens, distinct, size = segments.agg(F.sum("tokens"), F.sum("distinct"), F.sum(F.octet_length("bits") + F.octet_length("words") + F.octet_length("counts"))).first()
        self.tokens, self.distinct, self.bytes = tokens or 0, distinct or 0, size or 0
        self.weights = np.zeros((order + 1, 128))
        self.shared, self.asked = None, None
        if self.bytes <= max_broadcast:
            rows = segments.select("seg", "size", "bits", "words", "counts").toArrow().to_pylist()
            self.shared = segments.sparkSession.sparkContext.broadcast(_hold(rows, count))

    def each(self, docs: DataFrame, keep: list[str], make, fields: list, text: str = "text", learnt: Column | None = None) -> DataFrame:
        """``keep`` and what ``make(tokens, answers)`` returns (a list of arrays over the texts) for every row, or for those that ``learnt`` picks."""
        return self._sent(docs if learnt is None else docs.where(learnt), keep, make, fields, text) if self.shared is not None else self._joined(docs, keep, make, fields, text, learnt)

    def _sent(self, docs, keep, make, fields, text):
        src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
        schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(n, t) for n, t in fields)])
        names, shared, kinds = schema.names, self.shared, [to_arrow_type(t) for _, t in fields]

        def run(batches):
            held = Held(shared.value)
            for batch in batches:
                parts = [make(Tokens(some), held) for some in _steps(batch.column(batch.num_columns - 1), PROBE_BYTES)]
                if parts:
                    cols = [pa.array(np.concatenate([p[k] for p in parts]), kinds[k]) for k in range(len(fields))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *cols], names=names)

        return src.mapInArrow(run, schema)

    def _ask(self, docs, text, learnt):
        """Chunks of the rows, and what the segments reply to each: counts of its words, levels of its longer n-grams.

        A chunk asks each bucket of segments once, with its distinct n-grams in ascending order; a reply holds the values alone, in the same order.
        Both are kept, so that the texts that were learnt from are asked for once and not again with those to be scored.
        """
        if self.asked is None or self.asked[0] is not docs or self.asked[1] != text or learnt is not None and self.asked[2] is not learnt:
            order, count, shift = self.order, self.count, _bucket_shift(self.count)

            def ask(batches):
                for batch in batches:
                    for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                        tokens = Tokens.unpacked(row["words"], row["codes"], _read(row["rest"]).column("__n").to_numpy())
                        for longer, grams in enumerate((np.sort(tokens.words), _distinct(_longer(tokens, order)))):
                            bucket, _, steps = _blocks(grams, shift)
                            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), row["chunk"])), pa.array(np.full(len(bucket), longer > 0)), *steps],
                                                             names=["bucket", "chunk", "longer", "low", "high"])

            def reply(left: pa.Table, right: pa.Table) -> pa.Table:
                held, out = Held(_hold(right.to_pylist(), count)), []
                for longer in (False, True):
                    rows = left.filter(pc.equal(left.column("longer"), longer))
                    if rows.num_rows:
                        grams, n = _grams(rows, shift)
                        distinct, place = np.unique(grams, return_inverse=True)
                        values = (held.levels(distinct).astype(np.uint8) if longer else _small(held.counts(distinct)))[place]
                        out.append(pa.table([*(rows.column(c) for c in ("chunk", "bucket", "longer")), pa.array(np.full(len(n), values.itemsize)), _slices(values, np.append(0, np.cumsum(n)))],
                                            names=["chunk", "bucket", "longer", "width", "v"]))
                return pa.concat_tables(out) if out else no_reply

            no_reply = pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "longer": pa.array([], pa.bool_()), "width": pa.array([], pa.int64()), "v": pa.array([], pa.binary())})
            chunks = cut(_chunks(docs, text, F.lit(True) if learnt is None else F.coalesce(learnt, F.lit(False))))
            with cleaned_shuffles(docs.sparkSession):
                asked = chunks.mapInArrow(ask, "bucket long, chunk long, longer boolean, low binary, high binary")
                segments = self.segments.select(F.expr(f"seg div {SEGMENTS_A_BUCKET}").alias("bucket"), "seg", "size", "bits", "words", "counts")
                replies = cut(asked.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInArrow(reply, "chunk long, bucket long, longer boolean, width long, v binary"))
            self.asked = docs, text, learnt, chunks, replies
        return self.asked[3:]

    def _joined(self, docs, keep, make, fields, text, learnt):
        chunks, replies = self._ask(docs, text, learnt)
        if learnt is not None:
            chunks, replies = (t.where("chunk & 1 = 1") for t in (chunks, replies))
        order = self.order
        schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in fields)])
        names, kinds = schema.names, [to_arrow_type(t) for _, t in fields]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            rest = _read(row["rest"])
            tokens = Tokens.unpacked(row["words"], row["codes"], rest.column("__n").to_numpy())
            right = right.sort_by("bucket")
            values = {True: [np.empty(0, np.int64)], False: []}
            for longer, width, v in zip(*(right.column(c).to_pylist() for c in ("longer", "width", "v"))):
                values[longer].append(np.frombuffer(v, f"u{width}"))
            n, level = (np.concatenate(values[longer]).astype(np.int64) for longer in (False, True))
            cols = make(tokens, Values(tokens, order, n, level))
            return pa.table([*(rest.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

        return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def _histories(tokens: Tokens, answers, order: int, counts: np.ndarray):
    """For each order from two: the tokens with a known history, the history's count (upper end) and level, and the n-gram's level."""
    before = counts.astype(np.float64)
    for k in range(2, order + 1):
        at = np.flatnonzero((tokens.pos >= k - 1) & (np.concatenate([[0], before[:-1]]) > 0))
        history = before[at - 1]
        level = np.minimum(answers.levels_at(tokens, k, at), level_of(history))  # an n-gram is no more frequent than its history
        yield k, at, history, level
        before = np.zeros(len(before))
        before[at] = most_of(level)


def train(docs: DataFrame, order: int = ORDER, text: str = "text", max_broadcast: int = MAX_BROADCAST_BYTES, learnt: Column | None = None) -> Model:
    """A model of the texts of ``docs``, or of those rows that ``learnt`` picks.

    Words are counted exactly; n-grams of two to ``order`` tokens go into a filter as (n-gram, level) for every level up to that of
    their count. N-grams are combined within each step of a task, then summed after one shuffle by buckets of segments; a segment is a
    range of the n-grams' hashes, so segments are alike in size whatever is frequent. The number of segments follows the bytes of text.

    Weights: for each order and level of the history, the share of training tokens whose n-gram was seen more than once (one
    less the Good-Turing estimate of what is unseen), measured by probing the finished filter with all training texts.
    """
    small_batches(docs.sparkSession)
    taught = docs if learnt is None else docs.where(learnt)
    size = taught.agg(F.sum(F.octet_length(text))).first()[0] or 0
    segments = 1 << max(1, math.ceil(math.log2(max(1, size / SEGMENT_BYTES))))
    shift = 64 - int(math.log2(segments))
    wide = _bucket_shift(segments)

    def count(batches):
        for batch in batches:
            for some in _steps(batch.column(0), STEP_BYTES):
                tokens = Tokens(some)
                for k in range(1, order + 1):
                    grams, n = np.unique(tokens.of(k)[tokens.pos >= k - 1], return_counts=True)
                    bucket, ends, steps = _blocks(grams, wide)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), k, np.int8)), *steps, _slices(n.astype("<u4"), ends)], names=["bucket", "o", "low", "high", "n"])

    def build(rows: pa.Table) -> pa.Table:
        kinds, found = rows.column("o").to_numpy(), []
        for k in np.unique(kinds):
            own = rows.filter(pa.array(kinds == k))
            grams, n = _grams(own, wide)[0], np.frombuffer(b"".join(own.column("n").to_pylist()), "<u4")
            by = np.argsort(grams)
            grams = grams[by]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            found.append((np.full(len(first), k), grams[first], np.add.reduceat(n[by], first, dtype=np.int64)))
        o, g, n = map(np.concatenate, zip(*found))
        seg = (g >> np.uint64(shift)).view(np.int64)
        by = np.argsort(seg, kind="stable")
        table = pa.table({"seg": seg[by], "o": o[by], "g": g[by].view(np.int64), "n": n[by]})
        at = np.append(np.unique(seg[by], return_index=True)[1], len(seg))
        return pa.concat_tables(_segment(table.slice(x, y - x)) for x, y in zip(at[:-1], at[1:]))

    with cleaned_shuffles(docs.sparkSession):
        raw = taught.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(count, "bucket long, o byte, low binary, high binary, n binary")
        built = cut(raw.groupBy("bucket").applyInArrow(build, "seg long, size long, bits binary, words binary, counts binary, tokens long, distinct long"))
    model = Model(built, segments, order, max_broadcast)
    if order > 1:
        def seen(tokens, answers):
            counts = answers.word_counts(tokens)
            out = np.zeros((order + 1, 128, 2), np.int64)
            for k, _, history, level in _histories(tokens, answers, order, counts):
                group = level_of(history)
                out[k, :, 0] += np.bincount(group, minlength=128)
                out[k, :, 1] += np.bincount(group[level > 1], minlength=128)
            o, g = np.nonzero(out[:, :, 0])
            found = np.empty(len(tokens.n), dtype=object)
            found[0] = np.stack([o, g, out[o, g, 0], out[o, g, 1]], axis=1).ravel().tolist()
            return [found]

        # Counts of a whole step stand in its first row, four numbers for each order and level; the other rows are null.
        each = F.expr("inline(transform(sequence(0, size(found) div 4 - 1), i -> named_struct('o', found[4 * i], 'g', found[4 * i + 1], 'n', found[4 * i + 2], 'm', found[4 * i + 3])))")
        with cleaned_shuffles(docs.sparkSession):
            found = model.each(docs, [], seen, [("found", T.ArrayType(T.LongType()))], text, learnt).where("size(found) > 0")
            sums = found.select(each).groupBy("o", "g").agg(F.sum("n"), F.sum("m")).collect()
        for o, g, n, twice in sums:
            model.weights[o, g] = twice / n
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_tokens, n_known, base_score and score of every row.

    base_score adds one to every word count. score interpolates: from the words up, each order takes its weight of the ratio of
    n-gram to history count (the lowest count of the n-gram's level over the history's highest) and leaves the rest to the order
    below; a token whose history is unknown takes the order below whole. With exact counts these sum to one over the words at most.
    """
    order, weights, n_all, n_distinct = model.order, model.weights, model.tokens, model.distinct

    def make(tokens, answers):
        counts = answers.word_counts(tokens)
        base = (counts + 1.0) / (n_all + n_distinct + 1.0)
        p = base.copy()
        for k, at, history, level in _histories(tokens, answers, order, counts):
            w = weights[k, level_of(history)]
            p[at] = w * np.minimum(least_of(level) / history, 1.0) + (1 - w) * p[at]
        known = np.bincount(tokens.doc, counts > 0, len(tokens.n))
        return [tokens.n, known.astype(np.int64), np.bincount(tokens.doc, np.log10(base), len(tokens.n)),
                np.bincount(tokens.doc, np.log10(np.maximum(p, 1e-300)), len(tokens.n))]

    return model.each(docs, keep, make, SCORES, text)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those that are not held out.

    A null or empty text is its end token. Repeated rows are learnt from and scored each. Hashes have 64 bits, so two words
    share a count with a probability of about V squared over 2**65.
    """
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    model = train(marked, learnt=~F.col("held_out"))
    return score(marked, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op1_lm_scoring": (op1_lm_scoring, None)}

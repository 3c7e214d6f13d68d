"""The operators against brute force on small tables that hold nulls, empty and long texts, ties, repeats and extra columns."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash

from longview.session import cut
from longview.llm import chat, decontam, licenses, lines, ngrams, packing, pages, quality, shards, simhash

RNG = random.Random(7)
VOCABULARY = ["w%d" % i for i in range(400)]


def words(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


LONG = words(6000)
ROWS = [(i, words(60), "en", "s%d" % (i % 3)) for i in range(30)]
ROWS += [(100, ROWS[0][1], "en", "s0"), (101, ROWS[0][1].upper(), "en", "s0"), (100, ROWS[0][1], "en", "s0"), (None, ROWS[5][1], None, None),
         (102, None, "en", None), (103, "", None, "s1"), (104, " \n\t ", "en", "s1"), (105, LONG, "en", "s2"), (106, LONG + " tail", "en", "s2"), (107, "one", "en", "s2")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.selectExpr("*", "cast(length(text) as long) n_chars", "'x' fingerprint", "1 fp").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    docs.selectExpr("*", "cast(0 as long) n_chars").limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def split(text):
    return (text or "").encode().lower().split()


def fingerprint(text, size=4):
    w = split(text)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_match_all_pairs(spark, sf_dir):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op2_simhash_dedup(spark, sf_dir).collect()]
    fps = [fingerprint(t) for _, t, _, _ in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {g: min((ROWS[i][0] for i in range(len(ROWS)) if group[i] == g and ROWS[i][0] is not None)) for g in group}
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted([(ROWS[i][0], f"{fps[i]:016x}", low[group[i]]) for i in range(len(ROWS))], key=key)


def test_hot_block_is_cut_and_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    base = RNG.getrandbits(64)
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})[:120] + [~base & (1 << 64) - 1]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    groups = simhash.near_groups(df, 4).select("doc_id", "group").collect()
    assert len(groups) == 121 and Counter(Counter(r.group for r in groups).values()) == {120: 1, 1: 1}


def test_dedup_stage_keeps_one_of_each_group(spark, sf_dir):
    rows = simhash.dedup_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()
    ids = [r.doc_id for r in rows]
    assert 0 in ids and not {100, 101} & set(ids) and len(set(ids) & {105, 106}) == 1 and len(set(ids) & {102, 103, 104}) == 1
    assert set(range(30)) - {5} <= set(ids) and len(ids) == len(set(ids))
    assert None in ids and 5 not in ids  # a null id sorts first


def _near_copies(rng):
    """Texts with swapped words and with words appended, cut off or inserted, so that pairs lie between similarity 0.6 and 1."""
    out = []
    for k in range(60):
        w = [rng.choice(VOCABULARY) for _ in range(rng.choice([25, 80, 300]))]
        new = [rng.choice(VOCABULARY) for _ in range(max(1, len(w) * rng.randint(1, 30) // 100))]
        at = rng.randrange(len(w))
        swapped = list(w)
        for i in rng.sample(range(len(w)), max(1, len(w) * rng.randint(0, 6) // 100)):
            swapped[i] = rng.choice(VOCABULARY)
        out += [w, w + new, w[: len(w) - len(new)], w[:at] + new + w[at:], swapped]
    return [" ".join(w) for w in out]


def _brute_groups(texts):
    sets = [{tuple(split(t)[i:i + 5]) for i in range(max(1, len(split(t)) - 4))} if split(t) else set() for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


@pytest.mark.parametrize("chunk", [2048, 4])
def test_dedup_finds_the_pairs_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)  # 4: hot keys, a second pass, chunks
    texts = _near_copies(random.Random(5))
    group = _brute_groups(texts)
    kept = simhash.dedup_stage(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    want = sorted({g: min(i for i in range(len(texts)) if group[i] == g) for g in group}.values())
    assert sorted(r.doc_id for r in kept) == want and 60 < len(want) < 250


def test_dedup_finds_near_copies_by_simhash_alone(spark, monkeypatch):
    monkeypatch.setattr(simhash, "prefixes", lambda docs, least, last=None: spark.createDataFrame([], "node long, keys array<long>"))  # no exact check
    rng = random.Random(11)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(600)) for _ in range(20)]
    rows = [*enumerate(texts), *((100 + i, t + " end") for i, t in enumerate(texts))]
    kept = simhash.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(20))


def test_dedup_counts_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLOT_BYTES", 1500)
    rng = random.Random(12)
    base = [rng.choice(VOCABULARY) for _ in range(120)]
    texts = []
    for k in range(60):  # a loose group: many pairs on both sides of the similarity
        w = list(base)
        at = rng.randrange(100)
        w[at:at + rng.randint(2, 14)] = [rng.choice(VOCABULARY) for _ in range(8)]
        texts.append(" ".join(w))
    group = _brute_groups(texts)
    got = simhash.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "mark long, text string")).collect()
    ties = lambda g: {frozenset(i for i in range(60) if g[i] == x) for x in set(g)}
    assert ties([r.group for r in sorted(got)]) == ties(group) and 1 < len(set(group)) < 60


def test_quality_statistics(spark, docs):
    odd = spark.createDataFrame([(1, "a b c d e f g h " * 3 + "#x|\nsame\nsame\n \n"), (2, None), (3, ""), (4, "é ö #*$%&|<>")], "doc_id long, text string")
    for df, rows in ((docs, ROWS), (odd, odd.collect())):
        got = {(r.doc_id, r.text): r for r in quality.statistics(df, ["doc_id", "text"]).collect()}
        for r in rows:
            t = r[1] or ""
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
            seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
            cover = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
            ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            g = got[r[0], r[1]]
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
                len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cover))


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(3)
    good = [(i, " ".join("x" * rng.randint(3, 8) for _ in range(200)), "en", "a" if i % 3 else "b") for i in range(600)]
    bad = [(1000 + i, " ".join("#" * 4 for _ in range(60)) + " " + " ".join(str(rng.random()) for _ in range(60)), "en", "a") for i in range(40)]
    stats = cut(quality.statistics(spark.createDataFrame(good + bad, SCHEMA), ["doc_id", "lang", "source"]))
    kept = {r.doc_id for r in quality.judge(stats).where("kept").collect()}
    assert not any(i >= 1000 for i in kept) and len(kept) >= 597


def test_chi_square():
    assert quality.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3) and quality.chi2_cdf(5.0, 3) == pytest.approx(0.828203, abs=1e-5)


def test_lines_and_guard(spark):
    rows = [(i, f"menu\n{words(5)}\n menu \n\nfoot", "en", "h") for i in range(20)] + [(50, "menu\nfoot", "en", "h"), (51, None, None, None), (52, "menu", "en", "other")]
    d = spark.createDataFrame(rows, SCHEMA)
    left = {r.doc_id: "\n".join(r.__getitem__("__lines")) for r in lines.drop_lines(d).collect()}
    assert left[3] == rows[3][1].split("\n")[1] + "\n" and left[50] == "" and left[51] == "" and left[52] == "menu"
    stage = {r.doc_id: r.text for r in lines.lines_stage(spark, d.selectExpr("*", "1L n_chars"), "").collect()}
    assert stage[50] == "menu\nfoot" and stage[3] == left[3] and len(stage) == len(rows)


def test_packing_is_whole_and_without_conflicts(spark, docs):
    placed = packing.pack(packing.sized(docs), capacity=100, shard_rows=16).collect()
    assert sum(r.n_tokens for r in placed) == sum(len(split(t)) for _, t, _, _ in ROWS)
    assert {r.doc_id for r in placed} == {r[0] for r in ROWS}
    for b in {r.bin_id for r in placed}:
        own = [r for r in placed if r.bin_id == b]
        assert sum(r.n_tokens for r in own) <= 100 and len({r.source for r in own}) == len(own)
        assert sorted((r.bin_offset, r.n_tokens) for r in own)[0][0] == 0


def test_near_copies_never_share_a_bin(spark, tmp_path):
    base = words(60)
    near = [base, base + " ", base.upper(), base.rsplit(" ", 1)[0] + " other", base + " tail"]
    rows = [(i, t, "en", "s%d" % i) for i, t in enumerate(near)] + [(10, None, "en", "t"), (11, "", "en", "u"), (None, words(40), None, None), (12, words(40), "en", "v")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    placed = packing.op5_best_fit_packing(spark, str(tmp_path)).collect()
    assert len({r.bin_id for r in placed if r.doc_id in range(5)}) == 5 and len(placed) == len(rows)


def test_bins_take_the_tightest_compatible():
    rng = random.Random(1)
    bins, plain = packing.Bins(100, 5, 40), []
    for _ in range(400):
        size, marks = rng.randint(1, 60), [rng.randrange(5), 5 + rng.randrange(40)]
        b, used = bins.place(size, marks)
        fit = [(100 - u, k) for k, (u, m) in enumerate(plain) if 100 - u >= size and not m & set(marks)]
        assert (100 - used, b) == (min(fit) if fit else (100, len(plain)))
        if not fit:
            plain.append((0, set()))
        plain[b] = (plain[b][0] + size, plain[b][1] | set(marks))


def test_shards_fit_and_split_only_when_too_large(spark, docs):
    limit = 4000
    rows = shards.assign(docs, limit).collect()
    assert len(rows) == len(ROWS)
    own = Counter()
    for r in rows:
        own[r.shard] = r.shard_bytes
        assert len(r.shard) == r.depth and (r.fits == (r.shard_bytes <= limit))
    assert all(not b.startswith(a) for a in own for b in own if a != b)
    for a, size in own.items():
        if a and own[a]:
            assert sum(s for b, s in own.items() if b.startswith(a[:-1])) > limit


def test_decontamination_against_windows(spark):
    items = [(1, words(30)), (2, words(50)), (3, "only four words here"), (4, None), (5, "!!")]
    changed = items[1][1].split()
    changed[48] = "other"
    rows = [(1, f"{words(40)} {items[0][1].upper()}, {words(30)}"), (2, f"{words(10)} {' '.join(changed)}"), (3, "so only four words here then"), (4, None),
            (5, words(300)), (6, " ".join(items[0][1].split()[:28])), (None, items[1][1])]
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (6, 1), (None, 2)}
    assert got[1, 1].similarity == 1.0 and got[1, 1].start_word == 40 and 0.8 <= got[2, 2].similarity < 1
    sliced = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slice_bytes=60)
    assert {(r.doc_id, r.item_id) for r in sliced.collect()} == set(got)


def test_decontamination_finds_changed_items_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PAIRS", 64)  # several steps
    rng, items, rows = random.Random(11), [], []
    for i in range(60):
        items.append((i, " ".join(rng.choice(VOCABULARY) for _ in range(60))))
        own = items[i][1].split()
        for at in rng.sample(range(60), rng.choice([1, 1, 2])):
            own[at] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(own)))

    def similarity(a, b):
        grams = [Counter(tuple(x.split()[k:k + 5]) for k in range(len(x.split()) - 4)) for x in (a, b)]
        size = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
        return size(grams[0] & grams[1]) / size(grams[0] | grams[1])

    want = {(i, j) for i, t in rows for j, x in items if similarity(t, x) >= 0.8}
    got = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and 20 < len(want) < 60


def test_scores(spark, sf_dir, docs):
    got = ngrams.op1_lm_scoring(spark, sf_dir).collect()
    import zlib
    held = {r[0]: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2 for r in ROWS}
    c = Counter(w for i, t, _, _ in ROWS if not held[i] for w in [*split(t), b""])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held[i], len(split(t)) + 1, sum(c[w] > 0 for w in [*split(t), b""]), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*split(t), b""]), 6)) for i, t, _, _ in ROWS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_joined_model_scores_alike(spark, docs):
    sent, joined = (ngrams.train(docs, order=3, max_broadcast=b) for b in (1 << 30, 0))
    assert sent.shared is not None and joined.shared is None and (sent.weights == joined.weights).all()
    a, b = (sorted(map(str, ngrams.score(docs, m, ["doc_id"]).collect())) for m in (sent, joined))
    assert a == b


def test_joined_model_of_many_chunks_and_buckets(spark, docs, monkeypatch):
    from pyspark.sql import functions as F
    for name, value in {"CHUNK_BYTES": 700, "SEGMENT_BYTES": 64, "SEGMENTS_A_BUCKET": 2}.items():
        monkeypatch.setattr(ngrams, name, value)
    marked = docs.select("doc_id", "text", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)).alias("own"))
    models = [ngrams.train(marked, order=3, max_broadcast=b, learnt=F.col("own")) for b in (1 << 30, 0)]
    apart = ngrams.train(marked.where("own"), order=3, max_broadcast=1 << 30)
    assert all((m.weights == apart.weights).all() and m.weights.any() and (m.tokens, m.distinct) == (apart.tokens, apart.distinct) for m in models)
    want = sorted(map(str, ngrams.score(marked, apart, ["own", "doc_id"]).collect()))
    assert all(sorted(map(str, ngrams.score(marked, m, ["own", "doc_id"]).collect())) == want for m in models) and len(want) == len(ROWS)
    others = docs.where("doc_id >= 100").select("text", "source")  # texts that the model has not been asked for yet
    a, b = (sorted(map(str, ngrams.score(others, m, ["source"]).collect())) for m in models)
    assert a == b and len(a) == 9


def test_disk_of_a_joined_model(spark):
    """Shuffle files of the whole job at any time, under a multiple of the text (28 times the text when single n-grams were joined with the texts)."""
    import threading
    from pathlib import Path

    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    over, most = threading.Event(), [0, 0]

    def used():
        size = 0
        for d in dirs:
            for f in Path(d).rglob("*shuffle_*"):
                try:
                    size += f.stat().st_size
                except OSError:
                    pass
        return size

    def watch():
        while not over.wait(0.05):
            most[1] = max(most[1], used())

    most[0] = used()
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        model = ngrams.train(docs, max_broadcast=0)
        assert model.shared is None and ngrams.score(docs, model, ["doc_id"]).where("n_known = n_tokens").count() == len(rows)
    finally:
        over.set()
        watcher.join()
    text = sum(len(t) for _, t in rows)
    assert most[1] - most[0] < 4 * text, (most, text)


def test_filter_never_forgets():
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(1)
    g, n = np.unique(rng.integers(0, 1 << 62, 5000)), None
    n = rng.integers(1, 50, len(g))
    seg = ngrams._segment(pa.table({"seg": np.zeros(len(g), np.int64), "o": np.full(len(g), 2), "g": g, "n": n}))
    held = ngrams.Held({**ngrams._hold(seg.to_pylist(), 2), "shift": 63})
    levels = held.levels(g.view(np.uint64))
    assert (levels >= ngrams.level_of(n)).all() and (levels == ngrams.level_of(n)).mean() > 0.95
    other = rng.integers(0, 1 << 62, 20000).view(np.uint64)
    assert (held.levels(other) > 0).mean() < 2.0 ** -ngrams.PROBES * 1.5


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<<s>", "<\\/s>", "[[INST]", "<</SYS>><<SYS>>", "", None, "a\\\\[INST]<", "\n", "<<ROLE>>x<<TEXT>>", "é\U0001F600<s>"]
    roles = ["system", "user", "assistant", "tool", None, "</s>"]
    rows = [(c, i, RNG.choice(roles), RNG.choice(nasty)) for c in range(60) for i in range(RNG.randint(1, 6))] + [(None, 0, "user", "x"), (99, None, "user", "y")]
    rows += [(200, i, r, "t") for i, r in enumerate(["system", "user", "assistant"])] + [(201, 0, "assistant", "t"), (202, 0, "user", "q")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    from pyspark.sql import functions as F
    for r in out.withColumn("back", chat.read_back(F.col("formatted"))).collect():
        own = sorted([(-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id])
        assert [(b.role, b.text) for b in r.back] == [(role, text) for _, role, text in own]
        assert "".join(s.text for s in r.segments) == r.formatted and sum(s.loss for s in r.segments) == sum(role == "assistant" for _, role, _ in own)
        if r.conv_id and r.conv_id >= 200:
            assert (r.valid, r.bad_turn) == {200: (True, None), 201: (False, 0), 202: (False, None)}[r.conv_id]


def test_license_join_matches_every_pair(spark, sf_dir):
    texts = ["Licensed under the Apache License, Version 2.0.", "released UNDER the mit license", "CC-BY and cc by cc by", "x\nAll rights reserved", None, "", "the of and under"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.block, r.template) for r in licenses.find_templates(d, ["doc_id"]).collect()}
    token = lambda t: set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    want = {(i, b, k) for i, t in enumerate(texts) for b, line in enumerate((t or "").split("\n")) for k, (_, x) in enumerate(licenses.TEMPLATES)
            if len(token(line) & token(x)) >= 0.8 * len(token(x)) - 1e-9}
    assert got == want and want
    places = {r.doc_id: [(p.start, p.label) for p in r.places] for r in licenses.phrase_places(d, ["doc_id"]).collect()}
    assert sorted(places[2]) == [(0, "cc-by"), (3, "cc-by"), (5, "cc-by")] and places[3] == [(1, "reserved")] and places[4] == []


def test_pages(spark):
    body = "<header>site</header><nav>menu</nav><div class='post-12'><p>One &amp; <b>t</b>wo</p><p>Three\n four<br>five</p><div class=comments><p>nice</p></div></div><div class=sidebar>x</div><footer>f</footer>"
    rows = [(i, "http://h.example/%d" % i, f"<html><body>{body}</body></html>") for i in range(3)]
    rows += [(7, None, None), (8, "http://h.example/8", ""), (9, "http://g.example", "<p>plain <script>var a='</p>'</script>text"), (10, "x", "<div class='ad'>buy</div>")]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got[0] == got[2] == "One & two Three four five" and got[7] == got[8] == "" and got[9] == "plain text" and got[10] == ""


def test_empty_tables(spark, empty_dir):
    from longview.llm.catalog import all_queries
    for name, (query, _) in all_queries().items():
        rows = query(spark, empty_dir).collect()
        assert len(rows) == (1 if name.startswith("op3_") else 0), name


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline
    clean = [(i, words(120), "en", "s%d" % i, 1) for i in range(12)]
    item = words(40)
    rows = [*clean, (50, clean[0][1], "en", "t", 1), (51, f"{words(60)} {item} {words(60)}", "en", "u", 1), (52, "too short", "en", "v", 1), (53, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA + ", n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(12))



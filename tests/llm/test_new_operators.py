"""Merkle manifest, tokenizer alignment and URL filters against brute force, on tables with nulls, empty and long texts, repeats."""

import hashlib
import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from longview.llm import aligned, licenses, merkle, urls
from longview.llm.common import table

RNG = random.Random(11)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def text(n):
    return " ".join(RNG.choice(["alpha", "Straße", "日本語", "gone\nby", "x", "naïve", "don't", "🙂", "the", "1234"]) for _ in range(n))


ROWS = [(i, "s%d" % (i % 3 if i % 2 else 0), "en", i, text(5)) for i in range(120)]
ROWS += [(200, None, None, None, None), (None, "s1", "de", 3, "a\nb"), (None, "s1", "de", 3, "a\nb"), (7, "s1", "en", 7, ROWS[7][4]), (7, "s1", "en", 7, "other"),
         (201, "", "en", 0, ""), (202, "Ärger", "de", 1, text(20000)), (203, "zz", "en", 1, "\n\n"), (204, "s2", "en", 1, " lead  two\n\n tail "), (205, "s2", "xx", 1, "▁ mark")]
PAGES = [(i, f"http{'s' * (i % 2)}://{h}.example.{t}/{lang}/{RNG.randrange(10**4)}{e}")
         for i, (h, t, lang, e) in enumerate((RNG.choice(["www.alpha", "beta", "M.Gamma"]), RNG.choice(["net", "com", "org"]), RNG.choice(["en", "de", "fr"]), RNG.choice(["", ".html", "?q=1", "#top"]))
                                             for _ in range(600))]
PAGES += [(900, None), (901, ""), (902, "no scheme/en/"), (903, "http://net"), (904, "http://example.net/en"), (905, "ftp://EXAMPLE.NET/en/?x://y.com/de/"), (906, "a://b://c/d"),
          (None, "http://example.com/de/"), (905, "ftp://EXAMPLE.NET/en/?x://y.com/de/"), (907, "http://ä.example.org/é/" + "long/" * 4000), (908, "http://a.net:80/"), (909, "http://xnet/"),
          (910, "http:///p"), (911, "http://." + "." * 3000 + "org/fr/x")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 key", "2 block", "'r' root", "3 place", "4 pairs", "5 __row").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string").selectExpr("*", "'h' host", "'p' path", "'r' rule", "'v' verdict", "1 score", "'a' action").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    return d


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    doc, source, lang, n, body = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, body)))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        a = at - at % 3
        out.append(("".join(level[a:at]), "".join(level[at + 1:a + 3])))
        at //= 3
    return out


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]])
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            node = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = plain_leaf((*r[:4], r[4].replace("\n", "")))
            for a, b in steps:
                node = h(a + node + b)
            out.append((r[0], plain_leaf(r), trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


KEY = lambda r: tuple((v is None, v if v is not None else 0) for v in r)


@pytest.mark.parametrize("height", [0, 1, 2, 7])
def test_manifest_matches_a_plain_tree(spark, sf_dir, monkeypatch, height):
    f = merkle.F
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    even = f.crc32(f.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(docs, f.when(even, f.translate("text", "\n", "")).otherwise(f.col("text")), height)
    want = plain_manifest(ROWS)
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_query_and_its_sql(spark, sf_dir):
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, sf_dir).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, source, lang, n_chars, text FROM '{sf_dir}/documents.parquet/*.parquet'")
    assert sorted(got, key=KEY) == sorted(con.execute(merkle.SQL).fetchall(), key=KEY)


def test_manifest_of_one_row_and_of_many_sources(spark):
    one = spark.createDataFrame(ROWS[:1], SCHEMA)
    r = merkle.manifest(one).first()
    assert r.leaf == r.root == r.subroot == r.folded_root == plain_leaf(ROWS[0]) and r.proof_sha256 == h("") and r.verified
    rows = [(i, "s%03d" % (i if i < 40 else 17), "en", 1, "t") for i in range(100)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), None, 1).collect()
    assert sorted((r.doc_id, r.root, r.proof_sha256, r.verified) for r in got) == sorted((w[0], w[3], w[4], True) for w in plain_manifest(rows))


def plain_alignment(tokens_a, tokens_b, body):
    full = (" " + body).encode()
    if not body or b"".join(t for _, t in tokens_a) != full or b"".join(t for _, t in tokens_b) != full:
        return [], [], []
    ends = []
    for side in (tokens_a, tokens_b):
        at, own = 0, []
        for i, t in side:
            at += len(t)
            own.append((at, i))
        ends.append(own)
    shared = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    groups, low = [], 0
    for end in shared:
        groups.append([[i for e, i in own if low < e <= end] for own in ends])
        low = end
    return [i for i, _ in tokens_a], [i for i, _ in tokens_b], groups


@pytest.fixture(scope="module")
def tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{aligned.FOLDER}/{aligned.A_FILE}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{aligned.FOLDER}/{aligned.B_FILE}")
    letters = {c: i for i, c in enumerate(aligned._byte_letters())}
    vocabulary = {i: t for t, i in json.load(open(f"{aligned.FOLDER}/{aligned.A_FILE}", encoding="utf-8"))["model"]["vocab"].items()}

    def of(body):
        ids = a.encode(" " + body, add_special_tokens=False).ids
        own = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(body)]
        return [(i, bytes(letters[c] for c in vocabulary[i])) for i in ids], own

    return of


@pytest.mark.parametrize("hot", [0, 5, 10**6])
def test_alignment_matches_a_plain_one(spark, sf_dir, tokens, monkeypatch, hot):
    monkeypatch.setattr(aligned, "WIDE_LINKS", 3)
    rows = [r for r in ROWS if r[0] != 202] + [(206, "s", "en", 1, "<|endoftext|></s> [INST]\x00"), (207, "s", "en", 1, " " * 50 + "\t\t\r\n"), (208, "s", "en", 1, "日本語テキスト" * 9), (209, "s", "en", 1, text(3000))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = aligned.with_counts(aligned.cut(aligned.aligned(docs, ["doc_id"])), hot)
    plain = [plain_alignment(*tokens(r[4] or ""), r[4] or "") for r in rows]
    links = [Counter((a, b) for ga, gb in groups for a in ga for b in gb) for _, _, groups in plain]
    count = Counter(p for own in links for p in own)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = []
    for r, (a, b, groups), own in zip(rows, plain, links):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((r[0], len(a), len(b), len(groups), sum(own.values()), h(written) if written else "",
                     sum(n for p, n in own.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in own.items())))
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY)
    assert want[-1][1] and not want[[r[0] for r in rows].index(205)][1]


def test_alignment_query(spark, sf_dir):
    rows = aligned.op12_cross_tokenizer_alignment(spark, sf_dir).collect()
    assert len(rows) == len(ROWS) and rows[0].asDict().keys() >= {"n_best", "count_sum", "groups_sha256"}
    assert all(r.n_best <= r.n_links <= r.count_sum for r in rows)


def test_long_runs_are_given_back_whole():
    with open(f"{aligned.FOLDER}/{aligned.A_FILE}", encoding="utf-8") as f, open(f"{aligned.FOLDER}/{aligned.B_FILE}", "rb") as g:
        both = aligned.Tokenizers(f.read(), g.read())
    out = aligned.align(*both.encode(["^" * 300000, " " * 1500000, ""]), both.sizes, aligned.written_ids())
    assert out["n_a"][0] and out["n_a"][1] and out["n_a"][2] == 0 and out["groups_sha256"][2] == ""


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    own = rest[len(host):]
    for c in "?#":
        own = own.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(rh + rp), rh + rp, a) for a, rh, rp in urls.RULES if (host == rh or host.endswith("." + rh)) and own.startswith(rp)]
    return host, own, max(fits)[1:] if fits else (None, None)


def plain_probability(counts, k_max, share, s, i):
    """Witten-Bell over the kept contexts, computed from the counters directly."""
    p = 1 / 256
    for k in range(min(k_max, i) + 1):
        own = counts[s[i - k:i]] if (k, s[i - k:i]) in counts["kept"] else None
        if own:
            p = (own[s[i]] + len(own) * p) / (sum(own.values()) + len(own))
    return p


def test_urls_match_a_plain_model(spark, sf_dir):
    got = urls.op13_url_filters(spark, sf_dir).collect()
    rows = [(p, u, *plain_url(u)) for p, u in PAGES]
    models = {}
    for action in urls.ACTIONS:
        counts, size = defaultdict(Counter), 0
        for _, u, host, own, (_, a) in rows:
            if a == action and hashlib.md5(u.encode()).hexdigest()[0] not in urls.HELD:
                s = b"\xfe" + (host + own).encode() + b"\xff"
                for i in range(1, len(s)):
                    size += 1
                    for k in range(min(urls.ORDER, i) + 1):
                        counts[s[i - k:i]][s[i]] += 1
        counts["kept"] = {(len(c), c) for c, n in counts.items() if sum(n.values()) >= urls.SHARE * size}
        models[action] = counts
    score = {}
    for u, host, own in {(u, host, own) for _, u, host, own, _ in rows}:
        s = b"\xfe" + (host + own).encode() + b"\xff"
        score[u] = sum(math.log(plain_probability(models["allow"], urls.ORDER, urls.SHARE, s, i)) - math.log(plain_probability(models["block"], urls.ORDER, urls.SHARE, s, i))
                       for i in range(1, len(s))) / (len(s) - 1)
    held = [(math.floor(score[u] * 100), a) for _, u, _, _, (_, a) in rows if a and hashlib.md5(u.encode()).hexdigest()[0] in urls.HELD]
    n = Counter(a for _, a in held)
    gain = lambda t: sum(b >= t for b, a in held if a == "allow") * n["block"] + sum(b < t for b, a in held if a == "block") * n["allow"]
    bound = min(range(-300, 301), key=lambda t: (-gain(t), abs(t), t))
    want = [(p, host, own, rule, a or ("allow" if math.floor(score[u] * 100) >= bound else "block"), score[u]) for p, u, host, own, (rule, a) in rows]
    got_sorted, want = sorted(map(tuple, got), key=KEY), sorted(want, key=KEY)
    assert [r[:5] for r in got_sorted] == [r[:5] for r in want]
    assert [r[5] for r in got_sorted] == pytest.approx([r[5] for r in want], abs=1e-5)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_url_query_and_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url FROM '{sf_dir}/pages.parquet/*.parquet'")
    cur = con.execute(urls.SQL)
    names = [d[0] for d in cur.description]
    got = [tuple(r) for r in urls.op13_url_filters(spark, sf_dir).select(*names).collect()]
    assert sorted(got, key=KEY) == sorted(cur.fetchall(), key=KEY)


def test_urls_held_out_accuracy(spark, sf_dir):
    rows = spark.createDataFrame([(a, (host + own).encode(), i % 3 == 0) for i, (_, u) in enumerate(PAGES) for host, own, (_, a) in [plain_url(u)] if a],
                                 "action string, __text binary, test boolean")
    models = urls.fit(rows.where("not test").select("action", "__text"))
    scored = urls.with_score(rows.where("test").select("action", "__text"), models).collect()
    assert sum((r.score >= 0) == (r.action == "allow") for r in scored) / len(scored) > 0.95


def test_urls_of_one_kind_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.score) for r in urls.judge(pages).collect()}
    assert got == {1: ("net/", "block", 0.0), 2: (None, "allow", 0.0)}


def test_empty_tables(spark, empty_dir):
    for module in (merkle, aligned, urls):
        for fn, _ in module.QUERIES.values():
            assert fn(spark, empty_dir).collect() == []


def test_wrapped_notices_are_found_like_by_brute_force(spark):
    rng, rows = random.Random(4), []
    for i, (_, notice) in enumerate(licenses.TEMPLATES):
        for width in (30, 50, 70, 400):
            before = " ".join(rng.choice(["the", "of", "plain", "under", "words"]) for _ in range(rng.randrange(12)))
            body = f"{before} {notice} and more"
            wrapped = body if width == 400 else "\n".join(textwrap.wrap(body, width))
            rows.append((100 * i + width, f"Title\n{wrapped}\n" + "tail\n" * rng.randrange(3)))
    rows += [(5000, None), (5001, ""), (5002, rows[1][1] + "\n" + rows[3][1]), (5003, "x\n" * 3000 + rows[2][1]), (rows[0][0], rows[0][1])]
    got = licenses.find_templates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 block", "2 lines", "'a' label"), ["doc_id"]).collect()
    token = lambda t: set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    want = set()
    for doc, body in rows:
        lines = (body or "").split("\n")
        for k, (_, notice) in enumerate(licenses.TEMPLATES):
            need = token(notice)
            for w in (1, 2, 3):
                hits = {(doc, b, w, k) for b in range(len(lines) - w + 1) if len(need & token(" ".join(lines[b:b + w]))) >= 0.8 * len(need) - 1e-9}
                if hits:
                    want |= hits
                    break
    assert {(r.doc_id, r.block, r.lines, r.template) for r in got} == want
    named = {(doc, licenses.TEMPLATES[k][0]) for doc, _, _, k in want}
    assert all((100 * i + 70, label) in named for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_lines_of_small_hosts_count_without_a_floor(spark):
    from longview.llm import lines

    rows = [(h, f"menu\nown {h} {i}\nfoot") for h in range(1, 13) for i in range(h)]
    rows += [(40, "menu\nx%d" % i if i < k else "y%d" % i) for k, i in [(3, i) for i in range(8)]] + [(41, "menu\nx%d" % i if i < 3 else "y%d" % i) for i in range(12)]
    d = spark.createDataFrame([(i, str(h), t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = {(r.source, r.doc_id): "menu" in r["__lines"] for r in lines.drop_lines(d).collect()}
    stays = {h: any(v for (s, _), v in got.items() if s == h) for h in {s for s, _ in got}}
    assert {int(h) for h, v in stays.items() if v} == {1, 2, 41}  # on all of three pages or more it goes, on 3 of 8 as well, on 3 of 12 it stays

"""URL filter: rules by host and path, and a ratio of character language models for the URLs that no rule fits.

Two variable-order Markov models over bytes are counted, one from accepted and one from rejected URLs. A context is kept where the
data support it, so its length varies from none to ORDER bytes; longer ones are smoothed by the shorter ones they end in. A URL is
rejected where its log-likelihood difference, divided by its length, falls under a bound that is calibrated on rows held back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longview.llm.common import LOWER, UPPER, table

#: (action, host, path): a rule fits its host and the hosts below it where the path starts with the rule's; the longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Bytes of the longest context.
ORDER = 5
#: A context is kept if it holds this share of its model's bytes or more, so an order has at most 1 / SHARE of them at any size.
SHARE = 1 / 5000
#: URLs whose MD5 starts with one of these digits calibrate, all others train.
HELD = "012"
#: The difference per byte is calibrated in steps of 1 / STEPS between -SPAN / STEPS and SPAN / STEPS.
STEPS, SPAN = 100, 2000
#: Marks around a URL; UTF-8 has no such bytes.
START, END = b"\xfe", b"\xff"
ACTIONS = ("allow", "block")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL and for one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``; columns of these names are replaced."""
    host, path = url_parts(F.col("url"))
    return pages.select(*[c for c in pages.columns if c not in ("host", "path")], host.alias("host"), path.alias("path"))


def with_rule(pages: DataFrame, rules: DataFrame, depth: int) -> DataFrame:
    """``pages`` (with host and path) and ``rule``, the longest rule that fits, and its ``action``; null where none fits.

    ``rules`` has action, rule_host and rule_path; ``depth`` is the most labels that a rule's host has. A page is looked up once
    for each number of labels, by an equi-join on that end of its host, so rows are neither multiplied nor regrouped. Of equally
    long rules the one that sorts last wins. The rules of one host are a list kept by hand and go into one array.
    """
    fits = rules.groupBy("rule_host").agg(F.collect_list(F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "action", "rule_path")).alias("__own"))
    best = F.lit(None)
    for k in range(1, depth + 1):
        # A host of fewer labels gives itself whole, which then meets its rule at more than one k, to no harm.
        key, own = f"__host{k}", f"__own{k}"
        pages = pages.withColumn(key, F.substring_index("host", ".", -k)).join(
            fits.select(F.col("rule_host").alias(key), F.col("__own").alias(own)), key, "left")
        fit = F.array_max(F.filter(own, lambda r: F.startswith(F.col("path"), r["rule_path"])))
        best = fit if k == 1 else F.greatest(best, fit)
    out = pages.withColumn("__rule", best)
    return out.select(*[c for c in pages.columns if not c.startswith("__")], F.col("__rule.rule").alias("rule"), F.col("__rule.action").alias("action"))


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For a batch of texts: the row each predicted byte belongs to, the byte, and for each order which bytes have such a context
    and the context packed into a long."""
    joined = b"".join(START + t + END for t in texts)
    data = np.frombuffer(joined, np.uint8).astype(np.int64)
    size = np.array([len(t) + 2 for t in texts])
    row = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(place > 0)
    packed, orders = np.zeros(len(at), np.int64), []
    for k in range(ORDER + 1):
        if k:
            packed = packed | np.where(place[at] >= k, data[np.maximum(at - k, 0)], 0) << (8 * (k - 1))
        orders.append((place[at] >= k, packed))
    return row[at], data[at], orders


def grams(rows: DataFrame) -> DataFrame:
    """action, k, gram and n: how often each byte follows each context of k bytes, by action of ``rows`` (action, text as binary).

    A gram is its context's bytes and the next one, packed into a long. Every batch is counted before the shuffle.
    """

    def run(batches):
        for batch in batches:
            for action in ACTIONS:
                texts = [t for a, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if a == action]
                if not texts:
                    continue
                _, nxt, orders = _windows(texts)
                for k, (there, context) in enumerate(orders):
                    seen, n = np.unique(context[there] << 8 | nxt[there], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([action] * len(seen), pa.string()), pa.array(np.full(len(seen), k), pa.int32()),
                                                      pa.array(seen, pa.int64()), pa.array(n, pa.int64())], names=["action", "k", "gram", "n"])

    return rows.mapInArrow(run, "action string, k int, gram long, n long").groupBy("action", "k", "gram").agg(F.sum("n").alias("n"))


def kept_grams(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """The grams of the contexts that hold ``share`` of their model's bytes, with the context's total and its number of next bytes."""
    contexts = counted.groupBy("action", "k", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("next"))
    whole = contexts.where("k = 0").select("action", F.col("total").alias("bytes"))
    kept = contexts.join(whole, "action").where(F.col("total") >= F.lit(share) * F.col("bytes")).drop("bytes")
    return counted.withColumn("context", F.shiftright("gram", 8)).join(kept, ["action", "k", "context"])


class Model:
    """The kept grams of one action as sorted arrays, one set for each order."""

    def __init__(self, rows: list):
        self.orders = []
        for k in range(ORDER + 1):
            own = sorted((r["gram"], r["n"], r["context"], r["total"], r["next"]) for r in rows if r["k"] == k)
            cols = np.array(own, np.int64).reshape(-1, 5)
            contexts, first = np.unique(cols[:, 2], return_index=True)
            self.orders.append((cols[:, 0], cols[:, 1], contexts, cols[first, 3], cols[first, 4]))

    def log_likelihood(self, nxt: np.ndarray, orders: list) -> np.ndarray:
        """Natural logarithm of every byte's probability: Witten-Bell smoothing from the shortest context to the longest kept."""
        p = np.full(len(nxt), 1 / 256)
        for (there, context), (gram, n, contexts, total, distinct) in zip(orders, self.orders):
            if not len(contexts):
                continue
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            hit = there & (contexts[c] == context)
            g = np.minimum(np.searchsorted(gram, context << 8 | nxt), len(gram) - 1)
            seen = np.where(gram[g] == context << 8 | nxt, n[g], 0)
            p = np.where(hit, (seen + distinct[c] * p) / (total[c] + distinct[c]), p)
        return np.log(p)


def fit(rows: DataFrame, share: float = SHARE) -> dict[str, Model] | None:
    """The two models from ``rows`` (action, text as binary); None where an action has no row.

    What reaches the driver are the kept grams: contexts are at most 1 / share for each order and action, each with at most 255
    next bytes, whatever the number of rows.
    """
    found = kept_grams(grams(rows), share).collect()
    own = {a: [r for r in found if r["action"] == a] for a in ACTIONS}
    return {a: Model(own[a]) for a in ACTIONS} if all(own.values()) else None


def with_score(rows: DataFrame, models: dict[str, Model] | None, text: str = "__text") -> DataFrame:
    """``rows`` with ``score`` instead of the binary column ``text``: log-likelihood as accepted less that as rejected, per byte (the end
    mark counts as one). Zero without models."""
    if models is None:
        return rows.withColumn("score", F.lit(0.0)).drop(text)
    sent = rows.sparkSession.sparkContext.broadcast(models)
    rest = [c for c in rows.columns if c != text]
    src = rows.select(*rest, text)
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches):
        allow, block = (sent.value[a] for a in ACTIONS)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if not texts:
                continue
            row, nxt, orders = _windows(texts)
            diff = allow.log_likelihood(nxt, orders) - block.log_likelihood(nxt, orders)
            score = np.bincount(row, diff, len(texts)) / np.bincount(row, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=schema.names)

    return src.mapInArrow(run, schema)


def _bin(score: Column) -> Column:
    return F.greatest(F.least(F.floor(score * STEPS), F.lit(SPAN)), F.lit(-SPAN)).cast("int")


def calibrate(scored: DataFrame) -> int:
    """The step from which a URL is accepted: it maximises the mean of both actions' hit rates over ``scored`` (action, score).

    Of equally good steps the one nearest to zero is taken, then the lower one; zero where an action has no row. The driver
    gets one row for each step at most.
    """
    rows = scored.groupBy(_bin(F.col("score")).alias("step")).agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]).collect()
    allow, block = np.zeros(2 * SPAN + 1, object), np.zeros(2 * SPAN + 1, object)
    for r in rows:
        allow[r["step"] + SPAN], block[r["step"] + SPAN] = r["allow"], r["block"]
    if not allow.sum() or not block.sum():
        return 0
    above = allow.sum() - np.cumsum(allow) + allow
    under = np.cumsum(block) - block
    gain = above * block.sum() + under * allow.sum()
    return min(range(-SPAN, SPAN + 1), key=lambda t: (-gain[t + SPAN], abs(t), t))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, share: float = SHARE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score.

    The rule's verdict stands where one fits. The URLs with a rule teach the models: most are counted, the rest (see HELD) set
    the bound. Host and path are what the models read; scheme, query and fragment are not. Null and odd URLs have an empty host
    and path and are judged by the models too; repeated rows are each judged. Without rows of both actions every score is zero
    and all others are allowed. Nothing is dropped; a column named host, path, rule, verdict or score is replaced.
    """
    spark = pages.sparkSession
    listed = spark.createDataFrame(rules, "action string, rule_host string, rule_path string")
    plain = pages.select(*[c for c in pages.columns if c not in ("rule", "verdict", "score", "action")])
    known = with_rule(with_parts(plain), listed, max(h.count(".") + 1 for _, h, _ in rules)).withColumn(
        "__text", F.concat("host", "path").cast("binary"))
    held = F.instr(F.lit(HELD), F.substring(F.md5(F.col("url").cast("binary")), 1, 1)) > 0
    taught = known.where("action is not null").select("action", "__text", held.alias("held"))
    models = fit(taught.where("not held").select("action", "__text"), share)
    bound = calibrate(with_score(taught.where("held").select("action", "__text"), models))
    scored = with_score(known, models)
    verdict = F.coalesce("action", F.when(_bin(F.col("score")) >= bound, "allow").otherwise("block"))
    return scored.select(*[c for c in scored.columns if c not in ("action", "score")], verdict.alias("verdict"), "score")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page's URL."""
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _sql() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    steps, prev = [], "start"
    for k in range(ORDER + 1):
        context = f"CASE WHEN i >= {k} THEN substr(x, 2 * (i - {k}) + 1, {2 * k}) END"
        steps.append(f"""at{k} AS (SELECT s.r, s.x, s.i, s.model, CASE WHEN c.total IS NULL THEN p ELSE (coalesce(g.n, 0) + c.next * p) / (c.total + c.next) END AS p
  FROM {prev} s LEFT JOIN contexts c ON c.k = {k} AND c.action = s.model AND c.context = {context}
  LEFT JOIN grams g ON g.k = {k} AND g.action = s.model AND g.context = {context} AND g.next = substr(x, 2 * i + 1, 2))""")
        prev = f"at{k}"
    return f"""
WITH rules AS (SELECT * FROM (VALUES {rules}) AS t(action, rule_host, rule_path)),
rest AS MATERIALIZED (SELECT page_id, url, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, r, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
known AS MATERIALIZED (SELECT r, any_value(page_id) AS page_id, any_value(url) AS url, any_value(host) AS host, any_value(path) AS path,
    arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action,
    any_value('FE' || hex(encode(host || path)) || 'FF') AS x
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r),
grams AS (SELECT action, k, substr(x, 2 * (i - k) + 1, 2 * k) AS context, substr(x, 2 * i + 1, 2) AS next, count(*) AS n
  FROM (SELECT action, x, unnest(range(1, len(x) // 2)) AS i FROM known WHERE action IS NOT NULL AND md5(url)[1] NOT IN ('0', '1', '2')),
  (SELECT unnest(range({ORDER + 1})) AS k) WHERE i >= k GROUP BY ALL),
contexts AS (SELECT * FROM (SELECT action, k, context, sum(n) AS total, count(*) AS next FROM grams GROUP BY ALL) c
  WHERE total >= {SHARE!r}::DOUBLE * (SELECT sum(n) FROM grams w WHERE w.k = 0 AND w.action = c.action)),
start AS (SELECT r, x, unnest(range(1, len(x) // 2)) AS i, model, 1 / 256.0::DOUBLE AS p FROM known, (SELECT unnest(['allow', 'block']) AS model)),
{', '.join(steps)},
scores AS (SELECT r, CASE WHEN (SELECT count(DISTINCT action) FROM grams) < 2 THEN 0 ELSE
    (sum(ln(p)) FILTER (model = 'allow') - sum(ln(p)) FILTER (model = 'block')) / (len(any_value(x)) // 2 - 1) END AS score FROM at{ORDER} GROUP BY r),
binned AS (SELECT known.*, score, greatest(least(floor(score * {STEPS}), {SPAN}), -{SPAN})::INT AS step FROM known JOIN scores USING (r)),
held AS (SELECT step, count(*) FILTER (action = 'allow') AS a, count(*) FILTER (action = 'block') AS b FROM binned
  WHERE action IS NOT NULL AND md5(url)[1] IN ('0', '1', '2') GROUP BY 1),
gains AS (SELECT t, coalesce((SELECT sum(a) FROM held WHERE step >= t), 0) * (SELECT sum(b) FROM held) + coalesce((SELECT sum(b) FROM held WHERE step < t), 0) * (SELECT sum(a) FROM held) AS gain
  FROM (SELECT unnest(range(-{SPAN}, {SPAN + 1})) AS t)),
bound AS (SELECT CASE WHEN (SELECT coalesce(least(sum(a), sum(b)), 0) FROM held) = 0 THEN 0 ELSE (SELECT t FROM gains ORDER BY gain DESC, abs(t), t LIMIT 1) END AS t)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN step >= (SELECT t FROM bound) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM binned
"""


SQL = _sql()
QUERIES = {"op13_url_filters": (op13_url_filters, SQL)}

"""Quality rules and robust outliers: minimum-covariance-determinant estimates per language and source, in DataFrame operations."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import SPACE, table
from longview.session import cut

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Statistics are held as whole multiples of 1/UNIT: their sums and products are exact in longs, whatever the order of adding.
UNIT = 1024
#: Spread that each statistic has for reasons other than quality; its square is added to the variance. See ``vector``.
TOLERANCE = (0.12, 0.5, 0.15, 0.15, 0.3)
COVERAGE, C_STEPS, MIN_GROUP = 0.75, 3, 200
DIMS = len(TOLERANCE)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
#: Distances are counted in bins of a sixteenth of an octave.
PER_OCTAVE, LOW_BIN = 16, -160


def chi2_cdf(x: float, k: int) -> float:
    """Series of the regularised incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


CUTOFF = chi2_quantile(0.999, DIMS)


def consistency(share: float) -> float:
    """What makes the covariance of the inner ``share`` of normal rows that of all of them."""
    return share / chi2_cdf(chi2_quantile(share, DIMS), DIMS + 2)


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) and n_upper of every text.

    Null texts count as empty. Windows are compared by a 64-bit hash of their words' hashes. Only a text in which a window comes
    twice sorts its windows; the words they cover are then counted from the sorted places, so a long text costs n log n.
    """
    h = "__h"
    a = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    a = a.withColumn("__w", F.array_remove(F.split("__t", SPACE + "+"), ""))
    a = a.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    a = a.select(
        *keep, F.size("__w").alias("__n"), F.length(F.concat_ws("", "__w")).alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[A-Z]+", ""))).alias("n_upper"),
        F.size("__l").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias(h))
    windows = F.transform(F.sequence(F.lit(0), F.col("__n") - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    a = a.withColumn("__x", F.when(F.col("__n") >= WINDOW, windows))
    a = a.withColumn("__p", F.when(F.size(F.array_distinct("__x")) < F.size("__x"),
                                   F.sort_array(F.transform("__x", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda j, k: F.get("__p", j)["x"] == F.get("__p", k)["x"]
    twice = F.filter("__p", lambda p, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    a = a.withColumn("__r", F.sort_array(F.transform(twice, lambda p: p["i"])))
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("__r", none, lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n")), lambda s: s["n"])
    longs = {"n_words": F.col("__n"), "n_repeat_words": F.coalesce(covered, F.lit(0))}
    longs |= {c: F.col(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper")}
    return a.select(*keep, *[e.cast("long").alias(c) for c, e in longs.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: log of the mean word length, log share of symbols, roots of the shares of repeated lines and
    of repeated words, log share of capitals."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    plain = [F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
             F.sqrt(F.col("n_repeat_words") / words), F.log1p(100 * F.col("n_upper") / chars)]
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(plain)]


def _sums() -> list[Column]:
    return ([F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)]
            + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS])


def _estimates(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Centre ``m``, inverse covariance ``a`` and log determinant from sums, by Cholesky's decomposition column by column."""
    var = [F.lit((t * UNIT) ** 2) for t in TOLERANCE]
    cov = {(i, j): scale * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n"))) + (var[i] if i == j else 0.0) for i, j in PAIRS}
    out = sums.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)], *[cov[p].alias(f"c{p[0]}{p[1]}") for p in PAIRS])
    total = lambda terms, start: reduce(add, terms, start)
    for j in range(DIMS):
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - total([F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0)), F.lit(1.0))))
        if j + 1 < DIMS:
            out = out.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - total([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, DIMS)})
    for i in range(DIMS):  # rows of the inverse of l
        out = out.withColumns({f"r{i}{j}": F.lit(1.0) / F.col(f"l{i}{i}") if i == j else
                               -total([F.col(f"l{i}{k}") * F.col(f"r{k}{j}") for k in range(j, i)], F.lit(0.0)) / F.col(f"l{i}{i}") for j in range(i + 1)})
    return out.select(*keys, "n", *[f"m{i}" for i in range(DIMS)], *[f"r{i}{j}" for i, j in PAIRS],
                      total([2 * F.log(f"l{i}{i}") for i in range(DIMS)], F.lit(0.0)).alias("logdet"))


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the estimates in the row."""
    rows = [reduce(add, [F.col(f"r{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)]) for i in range(DIMS)]
    return reduce(add, [r * r for r in rows])


def _inner(rows: DataFrame, params: DataFrame, least: Column, scale: float) -> DataFrame:
    """Estimates from the rows of smallest distance: whole bins of distance, until ``least`` rows of the group are in.

    Distances and sums are taken in one pass, counted by bin; a group's bins are some hundreds at most.
    """
    bins = F.greatest(F.floor(F.log2(distance() + 2.0**-12) * PER_OCTAVE), F.lit(LOW_BIN)).alias("bin")
    counted = rows.join(params.withColumnRenamed("n", "__n"), "grp").select("grp", "start", "x0", "x1", "x2", "x3", "x4", bins).groupBy("grp", "start", "bin").agg(*_sums())
    before = F.expr("coalesce(sum(n) over (partition by grp, start order by bin rows between unbounded preceding and 1 preceding), 0)")
    all_n = F.expr("sum(n) over (partition by grp, start)")
    inside = counted.withColumn("before", before).withColumn("all_n", all_n).where(F.col("before") < least)
    names = ["n", *[f"s{i}" for i in range(DIMS)], *[f"s{i}{j}" for i, j in PAIRS]]
    return cut(_estimates(inside.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in names]), ["grp", "start"], scale))


def _middle(rows: DataFrame) -> DataFrame:
    """First estimates from coordinates' medians and quartiles, which half of the rows cannot move."""
    long = rows.select("grp", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(DIMS)])).alias("dim", "x")).groupBy("grp", "dim", "x").agg(F.count(F.lit(1)).alias("n"))
    up = "over (partition by grp, dim order by x rows between unbounded preceding and current row)"
    ranked = long.withColumn("upto", F.expr(f"sum(n) {up}")).withColumn("all_n", F.expr("sum(n) over (partition by grp, dim)"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all_n"), F.col("x")))
    mid = ranked.groupBy("grp", "dim").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"), F.first("all_n").alias("all_n"))
    one = lambda i, c: F.max(F.when(F.col("dim") == i, F.col(c)))
    wide = mid.groupBy("grp").agg(F.max("all_n").alias("n"), *[one(i, "m").cast("double").alias(f"m{i}") for i in range(DIMS)],
                                  *[(1 / F.sqrt(one(i, "s") * one(i, "s") + (t * UNIT) ** 2)).alias(f"r{i}{i}") for i, t in enumerate(TOLERANCE)])
    wide = wide.withColumns({f"r{i}{j}": F.lit(0.0) for i, j in PAIRS if i != j})
    return wide.select("grp", F.lit(1).alias("start"), "n", *[f"m{i}" for i in range(DIMS)], *[f"r{i}{j}" for i, j in PAIRS], F.lit(0.0).alias("logdet"))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of each ``grp``: deterministic starts, C-steps, the smaller determinant, reweighted.

    ``rows`` has grp and x0.. (whole numbers). Two starts, all rows and the coordinates' middle, take ``C_STEPS`` steps each: the
    estimates of the ``COVERAGE`` of rows that are nearest by the estimates before. The start with the smaller determinant goes
    on to the rows within the 97.5 % quantile. Every step is one pass of partial sums; a group may hold any share of the rows.
    """
    classic = _estimates(rows.groupBy("grp").agg(*_sums()), ["grp"], 1.0).withColumn("start", F.lit(0))
    now = cut(classic.unionByName(_middle(rows)))
    inner = F.lit(COVERAGE) * F.col("all_n")
    for _ in range(C_STEPS):
        now = _inner(rows, now, inner, consistency(COVERAGE))
    best = now.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    now = now.join(best, ["grp", "start"])
    edge = math.floor(math.log2(chi2_quantile(0.975, DIMS)) * PER_OCTAVE)
    # All bins up to the quantile: the condition on earlier rows always holds, the one on the bin decides.
    return _inner(rows, now, F.when(F.col("bin") <= edge, F.col("all_n") + 1).otherwise(F.lit(0)), consistency(0.975))


def _groups() -> tuple[Column, Column, Column]:
    """A row's own group, its language's and everyone's; nulls are values."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source"))
    return F.concat_ws("\x01", lang, source), lang, F.lit("*")


def judge(stats: DataFrame) -> DataFrame:
    """``stats`` (with lang and source), base_failed, kept, distance (null where no group is large enough) of every row.

    Rows that fail the base rules take no part in the estimates. A language and source of fewer than ``MIN_GROUP`` rows uses the
    language's estimates, a small language those of all rows; where even these are fewer, the base rules alone decide.
    ``stats`` is read several times and should be materialised.
    """
    marked = stats.withColumn("base_failed", base_failed()).withColumns(dict(zip(("__g0", "__g1", "__g2"), _groups())))
    marked = marked.select("*", *vector())
    xs = [f"x{i}" for i in range(DIMS)]
    sound = marked.where("not base_failed")
    rows = sound.select(F.explode(F.array("__g0", "__g1", "__g2")).alias("grp"), *xs)
    est = robust_estimates(rows)
    size = sound.groupBy("__g0", "__g1", "__g2").agg(F.count(F.lit(1)).alias("n0"))
    by_lang = size.groupBy("__g1").agg(F.sum("n0").alias("n1"))
    every = size.agg(F.sum("n0")).first()[0] or 0
    pick = (size.join(by_lang, "__g1").withColumn("n2", F.lit(every))
            .select("__g0", F.when(F.col("n0") >= MIN_GROUP, F.col("__g0")).when(F.col("n1") >= MIN_GROUP, F.col("__g1"))
                    .when(F.col("n2") >= MIN_GROUP, F.col("__g2")).alias("grp")))
    params = cut(pick.join(est.drop("n", "start", "logdet"), "grp", "left").drop("grp"))
    out = marked.join(params, "__g0", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUTOFF))
    return out.select(*stats.columns, "base_failed", kept.alias("kept"), "distance")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    stats = cut(statistics(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"]))
    return judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows equal in id, text, language and source share their verdict."""
    del spark, sf_dir
    known = docs.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    stats = cut(statistics(known, ["doc_id", "lang", "source", "__mark"]))
    bad = judge(stats).where("not kept").select(F.col("__mark").alias("__own"), F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"),
                                                F.col("source").alias("__source")).distinct()
    same = ((F.col("__mark") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("lang").eqNullSafe(F.col("__lang"))
            & F.col("source").eqNullSafe(F.col("__source")))
    return known.join(bad, same, "left_anti").select(*docs.columns)


QUERIES = {"op4_quality_rules": (op4_quality_rules, None)}

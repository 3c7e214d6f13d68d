"""Exact ranking and calibration metrics per horizon.

Ranking metrics need every score in order. Scores are first counted per
(horizon, score), then prefix-summed by an ordered scan, so neither all pairs
nor one task per horizon is ever needed and ties count one half exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.functions.risk import SCORE_COLUMNS
from longview.functions.text import half_even

from .labels import known_only
from .scan import OrderedScan
from .splits import guard_predictions

# Published reference figures, for the report only.
PUBLISHED = {"roc_auc_year_1": 0.92, "c_index_6yr": 0.75}
ONE_CLASS_NOTE = "only one class present; ranking metrics are undefined"
EMPTY_NOTE = "no evaluated patient carries a known label; no metric is reported"


def with_labels(predictions: DataFrame, splits: DataFrame, split: str | None = None) -> DataFrame:
    """Predictions joined to known labels, ids compared as text."""
    known = known_only(splits)
    if split is not None:
        known = known.filter(F.col("split") == split)
    known = known.select(F.col("patient_id").cast("string").alias("patient_id"), "split", "label", "label_source")
    return predictions.withColumn("patient_id", F.col("patient_id").cast("string")).join(known, "patient_id")


def by_horizon(scored: DataFrame, columns: list[str] = SCORE_COLUMNS) -> DataFrame:
    """Wide score columns to (horizon, score, label) rows."""
    present = [c for c in columns if c in scored.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("horizon"), F.col(c).cast("double").alias("score")) for c in present])
    return scored.select("label", F.explode(pairs).alias("_p")).select("_p.horizon", "_p.score", "label")


def rank_scan(long: DataFrame) -> OrderedScan:
    """Per (horizon, score): positives, negatives and both counts up to it."""
    counted = long.groupBy("horizon", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return OrderedScan(counted, ["horizon"], ["score"])


def horizon_metrics(long: DataFrame, digits: bool = False) -> DataFrame:
    """n, positives, base rate, ROC-AUC, average precision, lift, Brier, C-index.

    Labels are 0 or 1. Ranking metrics are null where a horizon has one class
    only. Everything is read off the counted scores, so the rows are passed once.
    """
    scan = rank_scan(long)
    ranks = scan.running(pos_to=F.col("pos"), neg_to=F.col("neg")).result()
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    base = scan.df.groupBy("horizon").agg(
        F.sum(pos + neg).alias("n"), F.sum("pos").alias("n_positive"),
        F.sum(pos * F.pow(s - 1.0, 2.0) + neg * F.pow(s, 2.0)).alias("_squares"))
    p, n = F.col("n_positive"), F.col("n")
    pos_below, neg_below = F.col("pos_to") - pos, F.col("neg_to") - neg
    precision = (p - pos_below) / F.nullif(n - pos_below - neg_below, F.lit(0))
    ranked = ranks.join(base, "horizon").groupBy("horizon", "n", "n_positive", "_squares").agg(
        F.sum(pos.cast("double") * (neg_below + 0.5 * neg)).alias("_wins"), F.sum(pos * precision).alias("_ap"))
    both = (p > 0) & (p < n)
    auc = F.when(both, F.try_divide(F.col("_wins"), p.cast("double") * (n - p)))
    auprc, rate = F.when(both, F.try_divide(F.col("_ap"), p)), p / n
    out = ranked.select(
        "horizon", "n", "n_positive", rate.alias("base_rate"), auc.alias("roc_auc"), auprc.alias("auprc"),
        F.when(both, F.try_divide(auprc, rate)).alias("auprc_lift"), F.when(both, F.col("_squares") / n).alias("brier"), auc.alias("c_index"),
        F.when(~both, ONE_CLASS_NOTE).alias("note"))
    return rounded(out) if digits else out


def rounded(metrics: DataFrame) -> DataFrame:
    """Report digits, the lift taken from the rounded average precision."""
    digits = {"roc_auc": 4, "auprc": 4, "brier": 5, "c_index": 4}
    out = metrics.withColumns({c: half_even(F.col(c), n) for c, n in digits.items()}).withColumn(
        "auprc_lift", F.try_divide("auprc", "base_rate"))
    return out.withColumns({"auprc_lift": half_even(F.col("auprc_lift"), 2), "base_rate": half_even(F.col("base_rate"), 4)})


def bin_edges(bins: int = 10) -> list[float]:
    """Equal-width edges as doubles: multiples of the step, the last exactly one."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def score_bin(score: Column, bins: int = 10) -> Column:
    """Bin by comparison with the very edges; the last bin is closed, outside is null."""
    inner = bin_edges(bins)[1:-1]
    place = sum((F.when(score >= e, 1).otherwise(0) for e in inner), F.lit(0))
    return F.when(score.between(0.0, 1.0), place)


def reliability(long: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score against observed rate in equal bins; empty bins are absent."""
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    grouped = long.withColumn("bin", score_bin(F.col("score"), bins)).filter("bin is not null").groupBy("horizon", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("predicted"), F.avg("label").alias("observed"))
    return grouped.withColumns({"bin_lo": F.get(edges, F.col("bin")), "bin_hi": F.get(edges, F.col("bin") + 1)})


def cohort_percentile(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of reference scores strictly below each score, in whole percent.

    ``scores`` has patient_id and score, ``reference`` has score. Both run in
    one ordered scan: at a tie the asked row comes first, so it counts none.
    Null without a reference or without a score.
    """
    asked = scores.select("patient_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("_ref"))
    known = reference.select(F.lit(None).cast("string").alias("patient_id"), F.col("score").cast("double").alias("score"),
                             F.lit(1).alias("_ref"))
    ran = OrderedScan(asked.unionByName(known), [], ["score", "_ref", "patient_id"]).running(below=F.col("_ref")).result()
    share = F.try_divide(F.col("below"), known.agg(F.count("score")).scalar()) * 100
    return ran.filter("_ref = 0").select("patient_id", "score", F.when(F.col("score").isNotNull(), F.bround(share).cast("int")).alias("cohort_percentile"))


def evaluation_report(predictions: DataFrame, splits: DataFrame, evaluated: str = "test") -> dict[str, DataFrame]:
    """The evaluation (A16): guard first, then header, sources, horizons and bins.

    The parts are frames, so nothing is drawn to the driver but the guard's counts.
    """
    guard_predictions(predictions, splits, evaluated)
    merged = with_labels(predictions, splits)
    long = by_horizon(merged)
    labelled = merged.agg(F.count(F.lit(1))).scalar()
    header = predictions.agg(F.count(F.lit(1)).alias("n_predicted")).withColumn("n_labelled", labelled).select(
        F.lit(evaluated).alias("split"), "n_predicted", "n_labelled",
        (F.col("n_predicted") - F.col("n_labelled")).alias("n_unmatched"), F.lit("passed").alias("leakage_guard"),
        F.when(F.col("n_labelled") == 0, EMPTY_NOTE).alias("note"),
        *[F.lit(v).alias(f"published_{k}") for k, v in PUBLISHED.items()])
    sources = merged.groupBy("label_source").agg(F.count(F.lit(1)).alias("patients"))
    return {"header": header, "label_sources": sources, "horizons": horizon_metrics(long, digits=True),
            "reliability": reliability(long)}

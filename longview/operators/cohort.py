"""Series index operators: primary choice, rounds, pairs, listings and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from longview.functions import descriptor as D
from longview.functions.hashing import DEFAULT_SEED, assign_split, hash_order, split_value

from .scan import OrderedScan
from .splits import with_split

# How a primary series is picked.
TIEBREAK_SEED = "series-pick"
UNKNOWN_SLICE_MM = 1e9


def annotate(series: DataFrame) -> DataFrame:
    """Decode ``series_description`` into the columns later stages use."""
    fields = F.col("_fields")
    decoded = series.withColumn("_fields", D.description_fields(F.col("series_description"))).withColumns({
        "patient_id": F.col("patient_id").cast("string"),
        "study_year": D.study_year(fields),
        "kernel": D.text_field(fields, "kernel"),
        "slice_mm": D.number_field(fields, "slice_mm"),
        "is_axial": D.is_axial(D.series_kind(fields)),
    }).drop("_fields")
    label = D.round_label(F.col("study_year"))
    return decoded.withColumns({
        "round": label, "kernel_style": D.kernel_style(F.col("kernel")), "round_key": D.round_key(label, F.col("study_date"))})


def usable(series: DataFrame, modality: str = "CT", min_slices: int = 10) -> DataFrame:
    """Series of one modality with enough slices."""
    return series.filter((F.col("modality") == modality) & (F.col("instance_count") >= min_slices))


def select_primary(series: DataFrame) -> DataFrame:
    """Flag one series per patient and round.

    The winner is a minimum over a preference tuple, so it is combined before
    the shuffle and no group is ever sorted in one task; losers stay in the
    table with the flag off. ``series_uid`` must be unique.
    """
    preference = F.struct(
        (~F.col("is_axial")).alias("localizer"),
        D.kernel_rank(F.col("kernel_style")).alias("kernel"),
        F.coalesce("slice_mm", F.lit(UNKNOWN_SLICE_MM)).alias("slice"),
        F.coalesce(-F.col("instance_count").cast("bigint"), F.lit(1)).alias("slices"),
        split_value(F.col("series_uid"), TIEBREAK_SEED).alias("tiebreak"),
        F.col("series_uid"),
    )
    keyed = series.select("patient_id", "round_key", "series_uid", "is_axial", "kernel_style", "slice_mm", "instance_count")
    winners = (
        keyed.groupBy("patient_id", "round_key").agg(F.min(preference).alias("best"))
        .select(F.col("best.series_uid").alias("series_uid"), F.lit(True).alias("_won"))
    )
    flagged = series.join(winners, "series_uid", "left")
    return flagged.withColumn("is_primary", F.coalesce("_won", F.lit(False))).drop("_won")


def primary_only(series: DataFrame) -> DataFrame:
    return series.filter("is_primary")


def first_patients(series: DataFrame, n: int) -> DataFrame:
    """Keep the series of the first ``n`` patient ids (P12); a development aid of the API."""
    keep = series.select("patient_id").distinct().orderBy("patient_id").limit(n)
    return series.join(keep, "patient_id", "left_semi")


def rounds_per_patient(series: DataFrame) -> DataFrame:
    """Distinct rounds and series of each patient, over primary series (A1)."""
    return primary_only(series).groupBy("patient_id").agg(
        F.count_distinct("round_key").alias("n_rounds"), F.count_distinct("series_uid").alias("n_series"))


def cohort_summary(series: DataFrame) -> DataFrame:
    """Size of the cohort in one row (A2)."""
    return series.agg(
        F.count(F.lit(1)).alias("series"),
        F.count_if("is_primary").alias("primary_series"),
        F.count_distinct("patient_id").alias("patients"),
        F.count_distinct("study_uid").alias("studies"),
        (F.sum("series_size_mb") / 1e6).alias("total_tb"),
    )


def round_histogram(series: DataFrame) -> DataFrame:
    """Primary series by round label (A2)."""
    return primary_only(series).filter(F.col("round").isNotNull()).groupBy("round").agg(F.count(F.lit(1)).alias("series"))


def rounds_per_patient_histogram(series: DataFrame) -> DataFrame:
    """Patients by their number of rounds (A2)."""
    return rounds_per_patient(series).groupBy("n_rounds").agg(F.count(F.lit(1)).alias("patients"))


def patient_series(series: DataFrame, patient_id: str, primary: bool = True) -> DataFrame:
    """One patient's series by round (P6); the id filter reaches the scan."""
    mine = series.filter(F.col("patient_id") == str(patient_id))
    return (primary_only(mine) if primary else mine).orderBy("round_key", "series_uid")


def with_alternates(series: DataFrame) -> DataFrame:
    """Primary series with the number of other reconstructions of their round."""
    others = series.filter(~F.col("is_primary")).groupBy("patient_id", "round_key").agg(
        F.count(F.lit(1)).alias("alternate_reconstructions"))
    out = primary_only(series).join(others, ["patient_id", "round_key"], "left")
    return out.withColumn("alternate_reconstructions", F.coalesce("alternate_reconstructions", F.lit(0)))


def _by_round() -> W:
    # Primary series only: one row per round, so a patient's group is no larger
    # than the number of rounds or dates there are, whatever was scanned.
    return W.partitionBy("patient_id").orderBy("round_key")


def consecutive_pairs(series: DataFrame) -> DataFrame:
    """Each patient's neighbouring rounds as (earlier, later) rows."""
    w = _by_round()
    nxt = {c: F.lead(c).over(w).alias(f"later_{c}") for c in ("series_uid", "round_key", "series_size_mb", "instance_count")}
    return (
        primary_only(series)
        .select("patient_id", F.col("series_uid").alias("earlier_series_uid"), F.col("round_key").alias("from_round"),
                F.col("series_size_mb").alias("earlier_series_size_mb"), *nxt.values())
        .withColumnRenamed("later_round_key", "to_round")
        .filter(F.col("to_round").isNotNull())
    )


def neighbour_rounds(series: DataFrame) -> DataFrame:
    """The previous and next labelled round of each primary series."""
    w = W.partitionBy("patient_id").orderBy("round")
    return primary_only(series).filter(F.col("round").isNotNull()).select(
        "patient_id", "series_uid", "round",
        F.lag("round").over(w).alias("previous_round"), F.lead("round").over(w).alias("next_round"))


def latest_round(series: DataFrame) -> DataFrame:
    """The last primary series of each patient by round."""
    best = F.max_by(F.struct("series_uid", "round_key"), F.struct("round_key", "series_uid"))
    return primary_only(series).groupBy("patient_id").agg(best.alias("_b")).select("patient_id", "_b.series_uid", "_b.round_key")


def fits_together(pairs: DataFrame, cap_bytes: float) -> DataFrame:
    """Whether both series of a pair fit the working-set budget (A31, ST6)."""
    pair_bytes = (F.col("earlier_series_size_mb") + F.col("later_series_size_mb")) * 1e6
    return pairs.withColumns({"pair_bytes": pair_bytes, "fits": pair_bytes <= cap_bytes})


def download_progress(series: DataFrame) -> DataFrame:
    """Running and total size per patient in fetch order.

    A patient may hold any share of the series, hence the ordered scan.
    """
    rows = series.select("patient_id", "round_key", "series_uid", "series_size_mb")
    scan = OrderedScan(rows, ["patient_id"], ["round_key", "series_uid"])
    ran = scan.running(done_mb=F.col("series_size_mb")).total(total_mb=F.col("series_size_mb")).result()
    return ran.withColumn("progress", F.col("done_mb") / F.greatest("total_mb", F.lit(1.0)))


def patient_overview(series: DataFrame, cached: DataFrame | None = None, seed: str = DEFAULT_SEED, splits: DataFrame | None = None) -> DataFrame:
    """Counts and sizes of each patient (A7). ``cached`` lists series_uid on disk."""
    rows = series
    if cached is None:
        rows = rows.withColumn("_cached", F.lit(False))
    else:
        have = cached.select("series_uid").distinct().withColumn("_cached", F.lit(True))
        rows = rows.join(have, "series_uid", "left").withColumn("_cached", F.coalesce("_cached", F.lit(False)))
    size = F.col("series_size_mb")
    one = F.col("is_primary")
    return with_split(
        rows.groupBy("patient_id").agg(
            F.count_if(one).alias("n_rounds"),
            F.count(F.lit(1)).alias("n_series"),
            F.sum(size).alias("total_mb"),
            F.coalesce(F.sum(F.when(one, size)), F.lit(0.0)).alias("primary_mb"),
            F.coalesce(F.sum(F.when(one & F.col("_cached"), size)), F.lit(0.0)).alias("cached_mb"),
        ), splits, seed)


def patient_rounds(series: DataFrame, screening: DataFrame | None = None) -> DataFrame:
    """One row per patient and round with what was scanned and read.

    ``screening`` has patient_id, round, screen_result, screen_days.
    """
    rows = with_alternates(series).withColumn("round_name", F.coalesce("round", "round_key"))
    if screening is None:
        return rows.withColumns({"screen_result": F.lit(None).cast("string"), "screen_days": F.lit(None).cast("bigint")})
    reads = screening.withColumnRenamed("round", "round_name")
    return rows.join(reads, ["patient_id", "round_name"], "left")


def cohort_listing(splits: DataFrame, split: str | None = None, limit: int | None = 50, min_rounds: int = 1,
                   query: str | None = None, label: int | None = None) -> DataFrame:
    """Patients matching the filters, by id."""
    if limit is not None and not 1 <= limit <= 1000:
        raise ValueError("limit must lie in 1..1000")
    out = splits.filter(F.col("n_rounds") >= min_rounds)
    if split:
        out = out.filter(F.col("split") == split)
    if query:
        out = out.filter(F.col("patient_id").contains(query))
    if label is not None:
        out = out.filter(F.col("label") == label)
    out = out.select("patient_id", "split", "n_rounds", "label", "label_source")
    return out if limit is None else out.orderBy("patient_id").limit(limit)


def listing_without_splits(series: DataFrame, seed: str = DEFAULT_SEED) -> DataFrame:
    """Stand-in splits from the hash when no splits table exists."""
    return rounds_per_patient(series).withColumns({
        "split": assign_split(F.col("patient_id"), seed), "label": F.lit(-1), "label_source": F.lit("none")})


def choose_patient(splits: DataFrame, seed: int | str, split: str | None = "test", min_rounds: int = 2,
                   patient_id: str | None = None) -> DataFrame:
    """A requested patient, or a seeded pick among the eligible (P5)."""
    if patient_id is not None:
        return splits.filter(F.col("patient_id") == patient_id)
    out = cohort_listing(splits, split=split, limit=None, min_rounds=min_rounds)
    return out.orderBy(hash_order(F.col("patient_id"), seed), "patient_id").limit(1)


def sample_series(series: DataFrame, n: int, order: str, seed: int | str | None = None) -> DataFrame:
    """First ``n`` in order, or a seeded sample put back in order."""
    if seed is None:
        return series.orderBy(order).limit(n)
    return series.orderBy(hash_order(F.col(order), seed), order).limit(n).orderBy(order)


def enough_slices(slices: DataFrame, min_slices: int) -> DataFrame:
    """Series that hold at least ``min_slices`` slice rows."""
    return slices.groupBy("series_uid").agg(F.count(F.lit(1)).alias("n_slices")).filter(F.col("n_slices") >= min_slices)


def not_yet_processed(series: DataFrame, done: DataFrame) -> DataFrame:
    """Series absent from the processed set."""
    return series.join(done.select("series_uid"), "series_uid", "left_anti")


def viewer_order(entries: DataFrame) -> DataFrame:
    """Index order: patient, study date, kernel."""
    return entries.orderBy("patient", F.coalesce("study_date", F.lit("")), F.coalesce("kernel", F.lit("")), "id")

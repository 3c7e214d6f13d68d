"""Split assignment and its guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from longview.functions.hashing import DEFAULT_FRACTIONS, DEFAULT_SEED, SPLITS, assign_split, check_fractions, split_bucket


def hash_split(patients: DataFrame, seed: str = DEFAULT_SEED, fractions: Sequence[float] = DEFAULT_FRACTIONS,
               id_col: str = "patient_id") -> DataFrame:
    """Pure hash split: id-local, no shuffle."""
    return patients.withColumns({"split": assign_split(F.col(id_col), seed, fractions), "split_mode": F.lit("hash"),
                                 "split_seed": F.lit(seed)})


def with_split(rows: DataFrame, splits: DataFrame | None, seed: str = DEFAULT_SEED) -> DataFrame:
    """The declared split of each patient; a patient the table lacks has none. Without a table, the hash decides."""
    if splits is None:
        return rows.withColumn("split", assign_split(F.col("patient_id"), seed))
    declared = splits.select(F.col("patient_id").cast("string").alias("patient_id"), "split")
    return rows.drop("split").join(declared, "patient_id", "left")


def stratified_split(patients: DataFrame, stratum: str, seed: str = DEFAULT_SEED,
                     fractions: Sequence[float] = DEFAULT_FRACTIONS, id_col: str = "patient_id") -> DataFrame:
    """Exact proportions inside each stratum, in (hash, id) order.

    Ids must be unique. A stratum may hold most of the rows, so its order is
    built in two levels: counts over the 10,000 hash buckets give where each
    bucket starts, and only ids that share a bucket are ranked together.
    """
    train_f, val_f, _ = check_fractions(fractions)
    rows = patients.withColumn("_bucket", split_bucket(F.col(id_col), seed))
    counts = rows.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy(stratum)
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    n = F.sum("_c").over(whole)
    starts = counts.select(F.col(stratum).alias("_stratum"), F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), n.alias("_n"))
    starts = starts.withColumn("_train", F.bround(F.col("_n") * F.lit(train_f)).cast("bigint")).withColumn(
        "_val", F.least(F.bround(F.col("_n") * F.lit(val_f)).cast("bigint"),
                        F.greatest(F.lit(0), F.col("_n") - F.col("_train"))))
    local = W.partitionBy(stratum, "_bucket").orderBy(F.col(id_col).cast("string"))
    ranked = rows.withColumn("_i", F.row_number().over(local) - 1)
    place = F.col("_start") + F.col("_i")
    out = ranked.join(starts, ranked[stratum].eqNullSafe(F.col("_stratum")) & (F.col("_bucket") == F.col("_b")))
    split = F.when(place < F.col("_train"), "train").when(place < F.col("_train") + F.col("_val"), "val").otherwise("test")
    return out.withColumns({"split": split, "split_mode": F.lit("stratified"), "split_seed": F.lit(seed)}).drop(
        "_bucket", "_stratum", "_b", "_start", "_n", "_train", "_val", "_i")


def split_summary(splits: DataFrame) -> DataFrame:
    """Patients, series, labelled, positives and rate of each split (A3).

    All three splits appear, empty ones with zeros and no rate.
    """
    known = F.col("label") >= 0
    counted = splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("patients"), F.sum("n_series").alias("series"),
        F.count_if(known).alias("labelled"), F.count_if(F.col("label") == 1).alias("positives"))
    names = splits.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    filled = names.join(counted, "split", "left").na.fill(0, ["patients", "series", "labelled", "positives"])
    return filled.withColumn("rate", F.when(F.col("labelled") > 0, F.col("positives") / F.nullif("labelled", F.lit(0))))


def duplicate_ids(df: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """Ids on more than one row (U4)."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unexpected_splits(splits: DataFrame, allowed: Sequence[str] = SPLITS) -> DataFrame:
    """Split names outside the allowed set."""
    return splits.select("split").distinct().filter(~F.col("split").isin(list(allowed)) | F.col("split").isNull())


def shared_ids(left: DataFrame, right: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """Ids on both sides, compared as text."""
    as_text: Column = F.col(id_col).cast("string").alias(id_col)
    return left.select(as_text).intersect(right.select(as_text))


def _report(ids: DataFrame, message: str) -> None:
    # Ten ids and a count reach the driver, never the table.
    total = ids.count()
    if total:
        shown = [r[0] for r in ids.orderBy(ids.columns[0]).limit(10).collect()]
        more = f" (+{total - 10} more)" if total > 10 else ""
        raise AssertionError(f"{total} {message}: {', '.join(map(str, shown))}{more}")


def check_no_leakage(train: DataFrame, held_out: DataFrame, id_col: str = "patient_id") -> None:
    """Raise if a patient is on both sides of the wall."""
    _report(shared_ids(train, held_out, id_col), "patient(s) are in both train and held-out")


def wrong_split_ids(predictions: DataFrame, splits: DataFrame, evaluated: str) -> DataFrame:
    """Predicted ids declared in another split; ids without a split pass."""
    declared = splits.select(F.col("patient_id").cast("string").alias("patient_id"), "split")
    ids = predictions.select(F.col("patient_id").cast("string").alias("patient_id"))
    return ids.join(declared, "patient_id").filter(F.col("split") != evaluated).select("patient_id", "split")


def guard_predictions(predictions: DataFrame, splits: DataFrame, evaluated: str = "test") -> None:
    """Leakage guard of the evaluation: raises before any metric is computed.

    A sound table costs one counting job; the ids are looked up only on failure.
    """
    wrong = wrong_split_ids(predictions, splits, "")
    leaked, misplaced = wrong.agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") != evaluated)).first()
    if leaked:
        check_no_leakage(splits.filter("split = 'train'"), predictions)
    if misplaced:
        _report(wrong_split_ids(predictions, splits, evaluated).select("patient_id"),
                f"evaluated patient(s) are not in the '{evaluated}' split")


def assert_train_only(frame: DataFrame) -> None:
    """Raise if a fitting table holds rows of another split."""
    others = sorted(str(r[0]) for r in unexpected_splits(frame, ["train"]).limit(10).collect())
    if others:
        raise AssertionError(f"calibration data contains non-train split(s): {others}")


def verify(splits: DataFrame) -> None:
    """Every guard on a splits table; raises on the first violation."""
    _report(duplicate_ids(splits).select("patient_id"), "patient(s) appear more than once in the splits")
    check_no_leakage(splits.filter("split = 'train'"), splits.filter("split in ('val', 'test')"))
    strange = sorted(str(r[0]) for r in unexpected_splits(splits).limit(10).collect())
    if strange:
        raise AssertionError(f"unknown split label(s): {strange}")

"""The results object of every patient (R-C) and the calibration report (R-E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import narrative as N
from longview.functions.hashing import DEFAULT_SEED
from longview.functions.risk import curve_of, curve_violation, risk_struct
from longview.operators import calibration as K
from longview.operators.cohort import latest_round, primary_only
from longview.operators.metrics import cohort_percentile
from longview.operators.splits import with_split

PANEL_REGIONS = 8  # fixed value: regions the results panel draws for a pair
REGION_FIELDS = ("rank", "slice", "bbox", "centroid_mm", "volume_mm3", "delta_mm", "mean_delta_hu", "peak_delta_hu", "baseline_hu", "followup_hu",
                 "fill_fraction", "elongation", "kind", "side")
PAIR_FIELDS = ("from_round", "to_round", "n_regions", "registration_failed", "deformable", "selected_stage", "alignment_before_hu", "alignment_after_hu",
               "alignment_by_stage_hu", "inflation_shift_hu", "spacing_mm", "shape", "from_lung_ml", "to_lung_ml", "note", "overlay")


def risk_block(series: DataFrame, scores: DataFrame, calibrator: K.Calibrator, reference: DataFrame | None, model: str) -> DataFrame:
    """Calibrated risk of each patient's latest round; absent scores say so (R-C).

    ``scores`` has patient_id and raw year_1..year_6; curves are validated
    before and kept monotone after calibration. A curve that breaks a rule
    makes its own patient unavailable, with the rule as reason; the others go
    on. ``invalid_curves`` lists such rows.
    """
    judged = scores.withColumn("_broken", curve_violation(curve_of()))
    broken = judged.filter("_broken is not null").select("patient_id", F.concat(F.lit(N.INVALID_CURVE), "_broken").alias("_reason"))
    done = calibrator.apply(judged.filter("_broken is null").drop("_broken"))
    risk = done.select("patient_id", risk_struct(curve_of(), F.col("calibrated")).alias("_risk"), F.col("year_1").alias("score"))
    if reference is not None:
        places = cohort_percentile(risk.select("patient_id", "score"), reference).select("patient_id", "cohort_percentile")
        risk = risk.join(places, "patient_id")
    else:
        risk = risk.withColumn("cohort_percentile", F.lit(None).cast("int"))
    latest = latest_round(series).select("patient_id", F.col("round_key").alias("round"))
    out = latest.join(risk, "patient_id", "left").join(broken, "patient_id", "left")
    known = F.col("_risk").isNotNull()
    return out.select("patient_id", F.struct(
        (~known).alias("unavailable"), F.when(~known, F.coalesce("_reason", F.lit(N.NO_SCORE))).alias("reason"), F.when(known, F.lit(model)).otherwise("none").alias("model"), "round",
        *[F.col(f"_risk.{c}").alias(c) for c in ("year_1", "year_2", "year_3", "year_4", "year_5", "year_6", "curve", "calibrated")],
        "cohort_percentile").alias("risk"))


def invalid_curves(scores: DataFrame) -> DataFrame:
    """Scores whose raw curve breaks a rule, with the rule."""
    return scores.withColumn("violation", curve_violation(curve_of())).filter("violation is not null")


def change_block(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """Compared pairs of each patient with all their regions, by rank (R-C).

    ``pairs`` has patient_id, volume_id and the pair fields; ``overlay`` is where the pair's change overlay lies (``overlay_path``). The size and
    spacing of regions bound a pair's list: each takes its smallest volume, and
    a pair is one volume.
    """
    boxed = regions.withColumns({"bbox": F.array("z0", "y0", "x0", "z1", "y1", "x1"),
                                 "centroid_mm": F.array("centroid_z_mm", "centroid_y_mm", "centroid_x_mm")})
    listed = boxed.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct(*REGION_FIELDS))).alias("regions"))
    rows = pairs.join(listed, "volume_id", "left")
    pair = F.struct(*PAIR_FIELDS, F.get("regions", F.lit(0)).alias("top"), "regions")
    # One row per consecutive pair of rounds.
    pairs = F.sort_array(F.collect_list(pair))
    return rows.groupBy("patient_id").agg(F.transform(pairs, lambda p: p.withField(
        "alignment_by_stage_hu", F.map_from_entries(p["alignment_by_stage_hu"]))).alias("pairs"))


def panel_regions(results: DataFrame, n: int = PANEL_REGIONS) -> DataFrame:
    """The first regions of each pair as the panel lists them (W14); the record itself keeps all."""
    pairs = results.select("patient_id", F.explode("change.pairs").alias("p"))
    return pairs.select("patient_id", "p.from_round", "p.to_round", F.inline(F.slice("p.regions", 1, n)))


def results_objects(series: DataFrame, risk: DataFrame, change: DataFrame, attention: DataFrame | None,
                    code_rev: str, generated_at: str, tasks: tuple[str, ...] = ("risk", "change", "saliency"),
                    seed: str = DEFAULT_SEED, splits: DataFrame | None = None) -> DataFrame:
    """One nested record per patient, its summary rendered last from the record (R-C).

    ``attention`` has patient_id and top_slices. The split comes from ``splits``;
    only where no such table is given is it the hash.
    """
    patients = primary_only(series).groupBy("patient_id").agg(F.array_sort(F.collect_set("round_key")).alias("rounds"))
    rows = patients.join(risk, "patient_id", "left").join(change, "patient_id", "left")
    top = F.array().cast("array<int>")
    if attention is not None:
        rows, top = rows.join(attention.select("patient_id", "top_slices"), "patient_id", "left"), F.col("top_slices")
    note = F.when(F.size("rounds") < 2, N.ONE_ROUND_NOTE)
    r, available = F.col("risk"), F.col("risk").isNotNull() & ~F.col("risk.unavailable")
    summary = N.compose(
        N.risk_sentence(available, r["year_1"], r["cohort_percentile"], r["calibrated"]), N.horizon_sentence(available, r["curve"]),
        N.attention_sentence(F.coalesce(top, F.array().cast("array<int>"))), N.change_sentence(F.col("pairs")),
        N.registration_caveat(F.col("pairs")))
    task_list = F.array(*[F.lit(t) for t in tasks])
    return with_split(rows, splits, seed).select(
        "patient_id", "split", "rounds", task_list.alias("tasks"), "risk",
        F.struct(F.coalesce(top, F.array().cast("array<int>")).alias("top_slices")).alias("attention"),
        F.struct("pairs", note.alias("note")).alias("change"),
        N.stamp(F.coalesce(r["model"], F.lit("none")), code_rev, generated_at, tasks=task_list).alias("provenance"),
        summary.alias("summary"))


def calibration_run(scores: DataFrame, splits: DataFrame, method: str, evaluate_on: str = "val") -> dict[str, DataFrame]:
    """Fit on train, report on a held-out split (R-E)."""
    calibrator = K.fit_on_train(scores, splits, method)
    table, bins = K.held_out_report(calibrator, scores, splits, evaluate_on)
    info = K.fit_info(K.with_labels(scores, splits, "train"), method)
    return {"calibration": info, "held_out": table, "reliability_after": bins, "knots": calibrator.knots(scores.sparkSession)}

"""Coded clinical tables: dictionary, decoding, outcomes and patient records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.functions import outcome as O
from longview.functions.text import fixed1, half_even, strip

from .labels import keep_first
from .scan import exact_median

# Participant columns shown in a record.
PARTICIPANTS = "nlst_prsn"
TABLES = ("nlst_prsn", "nlst_canc", "nlst_screen", "nlst_ctab", "nlst_ctabc")
DEMOGRAPHICS = ["age", "gender", "race", "cigsmok"]
TUMOUR = ["de_stag", "de_stag_7thed", "de_type", "de_grade", "lesionsize"]
HISTOLOGY_COLUMNS = ["de_type", "de_type_7thed"]
ROUND_COLUMNS = {"T0": ("scr_res0", "scr_days0"), "T1": ("scr_res1", "scr_days1"), "T2": ("scr_res2", "scr_days2")}


def dictionary_codes(dictionary: DataFrame) -> DataFrame:
    """One row per (table, column, code) with its text.

    ``dictionary`` has short_table_name, column and values, an array of
    (option_code, option_description). A code listed twice keeps its last text.
    """
    rows = dictionary.select("short_table_name", "column", F.posexplode("values").alias("_i", "_o"))
    out = rows.select("short_table_name", "column", strip(F.col("_o.option_code")).alias("code"),
                      strip(F.col("_o.option_description")).alias("text"), "_i").filter("code <> '' and text <> ''")
    return out.groupBy("short_table_name", "column", "code").agg(F.max_by("text", "_i").alias("text"))


def dictionary_labels(dictionary: DataFrame) -> DataFrame:
    """Short labels by (table, column) (F16)."""
    return dictionary.groupBy("short_table_name", "column").agg(
        F.max(O.short_label(F.col("column_label"))).alias("column_label"))


def decode(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``decoded`` to rows of (short_table_name, column, value).

    Missing is null, a listed code its text, any other code itself. The side
    of the join that is broadcast is left to the runtime size check.
    """
    raw = strip(F.col("value").cast("string"))
    keyed = rows.withColumn("_code", F.when(~O.is_missing(F.col("value")), raw))
    book = codes.select("short_table_name", "column", F.col("code").alias("_code"), F.col("text").alias("_text"))
    out = keyed.join(book, ["short_table_name", "column", "_code"], "left")
    shown = F.when(F.col("column").isin(HISTOLOGY_COLUMNS), O.histology(F.col("_code")))
    return out.withColumn("decoded", F.coalesce(shown, "_text", "_code")).drop("_code", "_text")


def outcomes(participants: DataFrame, order: list[str]) -> DataFrame:
    """The label of every participant with its supporting facts."""
    people = participants.select(
        F.col("pid").alias("patient_id"),
        F.when(O.is_missing(F.col("candx_days")), 0).otherwise(1).alias("label"),
        F.lit("idc").alias("label_source"),
        O.as_int(F.col("candx_days")).alias("days_to_diagnosis"),
        O.as_int(F.col("canc_free_days")).alias("cancer_free_days"),
        O.as_int(F.col("cancyr")).alias("diagnosis_study_year"),
        *[F.col(c).alias(f"_{c}") for c in order],
    )
    return keep_first(people, "patient_id", [f"_{c}" for c in order]).drop(*[f"_{c}" for c in order])


def outcome_summary(outcome: DataFrame) -> DataFrame:
    """Outcome counts and the median follow-up in one row (A5)."""
    n, pos = F.count(F.lit(1)), F.count_if(F.col("label") == 1)
    median = exact_median(outcome, [], "cancer_free_days", "m").select(F.col("m").cast("bigint")).scalar()
    return outcome.agg(
        n.alias("patients"), pos.alias("positive"), F.count_if(F.col("label") == 0).alias("negative"),
        half_even(F.try_divide(pos, n), 4).alias("positive_rate")).withColumn("median_follow_up_days", median)


def diagnosis_years(outcome: DataFrame) -> DataFrame:
    """Positives by study year of diagnosis (A5)."""
    known = outcome.filter((F.col("label") == 1) & F.col("diagnosis_study_year").isNotNull())
    return known.groupBy("diagnosis_study_year").agg(F.count(F.lit(1)).alias("patients"))


def flag_mismatches(participants: DataFrame, cancers: DataFrame) -> DataFrame:
    """Participants flagged as diagnosed without a cancer row, and the reverse."""
    flagged = participants.filter(~O.is_missing(F.col("candx_days"))).select("pid").distinct()
    listed = cancers.select("pid").distinct()
    return flagged.join(listed, "pid", "left_anti").withColumn("missing_from", F.lit("cancers")).unionByName(
        listed.join(flagged, "pid", "left_anti").withColumn("missing_from", F.lit("participants")))


def lesion_sites(participants: DataFrame) -> DataFrame:
    """Names of the flagged lesion locations."""
    flags = {c: F.col(c) for c in participants.columns if c in O.LESION_LOCATIONS}
    return participants.withColumn("locations", O.lesion_locations(flags))


def _entries(columns: list[str], only_present: bool) -> Column:
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_f")[c]["label"].alias("label"),
                               F.col("_f")[c]["value"].alias("value")) for c in columns])
    return F.filter(found, lambda e: e["value"].isNotNull()) if only_present else found


def patient_records(participants: DataFrame, codes: DataFrame, labels: DataFrame, order: list[str]) -> DataFrame:
    """The decoded record of every participant in one pass.

    Coded columns are unpivoted, decoded by one join and folded back; a
    participant's group is as large as the fixed column list, no more.
    """
    flags = [c for c in O.LESION_LOCATIONS if c in participants.columns]
    results = [r for r, _ in ROUND_COLUMNS.values()]
    coded = [c for c in [*DEMOGRAPHICS, *TUMOUR, "cancyr", "can_scr", *results] if c in participants.columns]
    keep = ["candx_days", "canc_free_days", *[d for _, d in ROUND_COLUMNS.values() if d in participants.columns]]
    people = keep_first(participants.select("pid", *keep, *flags, *coded, *[F.col(c).alias(f"_{c}") for c in order]),
                        "pid", [f"_{c}" for c in order])
    long = people.select("pid", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in coded])).alias("_e")).select(
        "pid", F.lit(PARTICIPANTS).alias("short_table_name"), "_e.column", "_e.value")
    text = decode(long, codes).join(labels, ["short_table_name", "column"], "left").select(
        "pid", "column", O.column_label(F.col("column"), F.col("column_label")).alias("label"),
        O.with_units(F.col("column"), F.col("decoded")).alias("value"))
    fields = text.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("label", "value")))).alias("_f"))
    days = O.as_int(F.col("candx_days"))
    diagnosed = ~O.is_missing(F.col("candx_days"))
    value = lambda c: F.col("_f")[c]["value"]
    rounds = F.array(*[
        F.struct(F.lit(r).alias("round"), value(res).alias("result"), O.as_int(F.col(day)).alias("days_from_randomisation"),
                 (value(res).isNotNull() | ~O.is_missing(F.col(day))).alias("known"))
        for r, (res, day) in ROUND_COLUMNS.items() if day in keep and res in coded])
    return people.join(fields, "pid").select(
        F.col("pid").alias("patient_id"), F.lit(True).alias("found"), diagnosed.cast("int").alias("label"),
        F.lit("idc").alias("label_source"),
        F.struct(diagnosed.alias("diagnosed"), days.alias("days_to_diagnosis"), O.years_to_diagnosis(days).alias("years_to_diagnosis"),
                 value("cancyr").alias("diagnosis_study_year"), O.as_int(F.col("canc_free_days")).alias("cancer_free_days"),
                 value("can_scr").alias("screen_result_at_diagnosis")).alias("outcome"),
        _entries(DEMOGRAPHICS, False).alias("demographics"),
        F.transform(F.filter(rounds, lambda r: r["known"]), lambda r: F.struct(
            r["round"].alias("round"), r["result"].alias("result"),
            r["days_from_randomisation"].alias("days_from_randomisation"))).alias("screening"),
        F.when(diagnosed, _entries(TUMOUR, True)).otherwise(F.filter(_entries(TUMOUR, True), lambda e: F.lit(False))).alias("tumour"),
        F.when(diagnosed, O.lesion_locations({c: F.col(c) for c in flags})).otherwise(F.array().cast("array<string>")).alias("locations"))


def record_for(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the asked ids; ids without a participant come back not found."""
    out = ids.select("patient_id").join(records, "patient_id", "left")
    return out.withColumns({"found": F.coalesce("found", F.lit(False)), "label": F.coalesce("label", F.lit(O.UNKNOWN)),
                            "label_source": F.coalesce("label_source", F.lit("none"))})


def format_record(record: DataFrame) -> DataFrame:
    """A record as display lines (F37): patient_id, text."""
    o = F.col("outcome")
    when = F.when(F.length(o["diagnosis_study_year"]) > 0, F.concat(F.lit("study year "), o["diagnosis_study_year"])).otherwise("")
    years = F.when(o["years_to_diagnosis"] != 0, F.concat(o["years_to_diagnosis"].cast("string"), F.lit(" years from randomisation"))).otherwise("")
    headline = F.regexp_replace(F.concat(F.lit("  OUTCOME     lung cancer diagnosed — "), when, F.lit(", "), years), r"[, ]+$", "")
    screen = F.when(F.length(o["screen_result_at_diagnosis"]) > 0,
                    F.concat(F.lit("              screen at diagnosis: "), o["screen_result_at_diagnosis"]))
    span = F.when(o["cancer_free_days"] != 0, F.concat(F.lit(" over "), fixed1(o["cancer_free_days"] / 365.25),
                                                       F.lit(" years of follow-up"))).otherwise("")
    clean = F.concat(F.lit("  OUTCOME     no lung-cancer diagnosis on record"), span)

    def section(name: str, title: str) -> Column:
        kept = F.filter(F.col(name), lambda e: F.length(e["value"]) > 0)
        line = F.array_join(F.transform(kept, lambda e: F.concat(e["label"], F.lit(": "), e["value"])), " · ")
        return F.when(F.size(kept) > 0, F.concat(F.lit("  " + title.ljust(11) + " "), line))

    sites = F.when(F.size("locations") > 0, F.concat(F.lit("  LOCATION    "), F.array_join("locations", ", ")))
    reads = F.transform("screening", lambda s: F.concat(
        F.lit("  "), F.rpad(s["round"], 11, " "), F.lit(" day "),
        F.lpad(F.coalesce(s["days_from_randomisation"].cast("string"), F.lit("?")),
               F.greatest(F.lit(4), F.length(s["days_from_randomisation"].cast("string"))), F.lit(" ")),
        F.lit("  "), F.coalesce(s["result"], F.lit("—"))))
    lines = F.concat(F.array_compact(F.array(
        F.concat(F.lit("Patient "), F.col("patient_id")), F.when(o["diagnosed"], headline).otherwise(clean),
        F.when(o["diagnosed"], screen), section("tumour", "TUMOUR"), section("demographics", "PERSON"), sites)), reads)
    absent = F.concat(F.lit("Patient "), F.col("patient_id"), F.lit(": no NLST participant record."))
    return record.select("patient_id", F.when(F.col("found"), F.array_join(lines, "\n")).otherwise(absent).alias("text"))


def union_parts(*parts: DataFrame) -> DataFrame:
    """Parts of one table as one frame; pid becomes trimmed text."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.withColumn("pid", strip(F.col("pid").cast("string"))) if "pid" in whole.columns else whole

"""Registered queries over the series index and the splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import descriptor as D
from longview.functions import hashing as H
from longview.operators import cohort as C
from longview.operators import labels as L
from longview.operators import splits as S
from longview.plans import cohort as P
from longview.sources import manifests as M

from . import base as B
from .base import load


def _annotated(spark, sf) -> DataFrame:
    return C.annotate(B.index(spark, sf))


def _series(spark, sf) -> DataFrame:
    return P.build_cohort(B.index(spark, sf), B.MIN_SLICES)


def _patients(spark, sf) -> DataFrame:
    """Customers as patients, the market segment as stratum."""
    return load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), "c_mktsegment", "c_acctbal")


def _label_tables(spark, sf) -> list[DataFrame]:
    """Three label sources over customers, by balance and nation; the rows a source would not hold name no known patient."""
    c = load(spark, sf, "customer")
    pid = lambda test: F.when(F.expr(test), F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("none-"), F.col("c_custkey").cast("string"))).alias("patient_id")
    cdas = c.select(pid("c_acctbal < 0"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN -1 WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END").alias("label"), F.lit("cdas").alias("label_source"))
    manual = c.select(pid("c_nationkey < 20"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END").alias("label"), F.lit("manual").alias("label_source"))
    other = c.select(pid("c_nationkey % 2 = 0"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE -1 END").alias("label"),
                                                   F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'sybil' ELSE 'elsewhere' END").alias("label_source"))
    return [manual, other, cdas]


LABEL_TABLES_SQL = """tables AS (
  SELECT CASE WHEN c_acctbal < 0 THEN '' ELSE 'none-' END || c_custkey AS patient_id, CASE WHEN c_custkey % 3 = 0 THEN -1 WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END AS label, 'cdas' AS label_source, 0 AS rnk FROM customer
  UNION ALL SELECT CASE WHEN c_nationkey < 20 THEN '' ELSE 'none-' END || c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END, 'manual', 4 FROM customer
  UNION ALL SELECT CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'none-' END || c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE -1 END, CASE WHEN c_custkey % 2 = 0 THEN 'sybil' ELSE 'elsewhere' END,
    CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 6 END FROM customer),
picked AS (SELECT patient_id, label, label_source, row_number() OVER (PARTITION BY patient_id ORDER BY (label = -1), CASE WHEN label = -1 THEN -rnk ELSE rnk END) AS i FROM tables),
merged AS (SELECT patient_id, label, label_source FROM picked WHERE i = 1)"""

ROUNDS_SQL = f"""{B.PRIMARY_SQL},
patients AS (SELECT patient_id, count(DISTINCT round_key) AS n_rounds, count(DISTINCT series_uid) AS n_series FROM series WHERE is_primary GROUP BY 1)"""

STRATA_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY {s} ORDER BY bucket, patient_id) - 1 AS i, count(*) OVER (PARTITION BY {s}) AS n FROM hashed),
cuts AS (SELECT *, CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) AS n_train, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS want_val FROM ranked),
stratified AS (SELECT *, CASE WHEN i < n_train THEN 'train' WHEN i < n_train + least(want_val, greatest(0, n - n_train)) THEN 'val' ELSE 'test' END AS split FROM cuts)"""


def _stratified(spark, sf) -> DataFrame:
    return S.stratified_split(_patients(spark, sf), "c_mktsegment").select("patient_id", "c_mktsegment", "split", "split_mode", "split_seed")


def _split_table(spark, sf, stratify: bool) -> DataFrame:
    return P.build_splits(_series(spark, sf), *_label_tables(spark, sf), stratify=stratify)


SPLIT_TABLE_SQL = f"""WITH {ROUNDS_SQL}, {LABEL_TABLES_SQL},
labelled AS (SELECT patient_id, n_rounds, n_series, coalesce(label, -1) AS label, coalesce(label_source, 'none') AS label_source
  FROM patients LEFT JOIN merged USING (patient_id)),
hashed AS (SELECT *, {B.duck_bucket('patient_id')} AS bucket FROM labelled),
pure AS (SELECT *, {B.duck_split('patient_id')} AS split FROM labelled),
{STRATA_SQL.format(s='label')}"""

SUMMARY_SQL = """SELECT k.split, count(s.patient_id) AS patients, coalesce(sum(n_series), 0) AS series, count(*) FILTER (s.label >= 0) AS labelled,
  count(*) FILTER (s.label = 1) AS positives, round(count(*) FILTER (s.label = 1) / nullif(count(*) FILTER (s.label >= 0), 0), 9) AS rate
  FROM (SELECT unnest(['train', 'val', 'test']) AS split) k LEFT JOIN {t} s ON s.split = k.split GROUP BY 1"""


def _summary(spark, sf) -> DataFrame:
    return S.split_summary(_split_table(spark, sf, True)).withColumn("rate", F.round("rate", 9))


def _raw_lines(spark, sf) -> DataFrame:
    """Order lines as manifest lines, with headers, noise and unreadable copies among them."""
    k = F.col("l_orderkey")
    line = F.when(k % 50 == 0, F.concat(F.lit("# s5cmd header "), k.cast("string"))).when(k % 31 == 0, "mkdir out").when(
        k % 41 == 0, "cp s3://bucket/short/* .").otherwise(F.concat(F.lit("cp s3://open-bucket/"), B.uuid_of(k), F.lit("/* .")))
    # Made once, as a line of a file would be, not again in every test on it.
    return load(spark, sf, "lineitem").select(k.alias("k"), F.explode(F.array(line)).alias("line"))


MANIFEST_LINE = f"""CASE WHEN l_orderkey % 50 = 0 THEN concat('# s5cmd header ', CAST(l_orderkey AS VARCHAR(20))) WHEN l_orderkey % 31 = 0 THEN 'mkdir out'
  WHEN l_orderkey % 41 = 0 THEN 'cp s3://bucket/short/* .' ELSE concat('cp s3://open-bucket/', {B.uuid_text('l_orderkey')}, '/* .') END"""
LINES_SQL = rf"""lines AS (SELECT l_orderkey AS k, {MANIFEST_LINE} AS line FROM lineitem),
classified AS (SELECT k, line, CASE WHEN starts_with(line, '#') THEN 'header' WHEN contains(line, 's3://') THEN 'copy' END AS kind,
  nullif(regexp_extract(line, 's3://[^/]+/([0-9a-f-]{{36}})/', 1), '') AS crdc_series_uuid FROM lines
  WHERE starts_with(line, '#') OR contains(line, 's3://'))"""


def _lookup(keep: bool):
    def run(spark, sf) -> DataFrame:
        index = B.index(spark, sf).select("crdc_series_uuid", "patient_id", "modality", "series_size_mb")
        return M.lookup_series(M.classify_lines(_raw_lines(spark, sf)), index, keep).groupBy("crdc_series_uuid", "patient_id", "modality").agg(
            F.count(F.lit(1)).alias("lines"), F.round(F.max("series_size_mb"), 4).alias("series_size_mb"))
    return run


def _lookup_sql(join: str) -> str:
    return f"""WITH {LINES_SQL}, {B.INDEX_SQL} SELECT c.crdc_series_uuid, patient_id, modality, count(*) AS lines, round(max(series_size_mb), 4) AS series_size_mb
      FROM classified c {join} JOIN idx ON idx.crdc_series_uuid = c.crdc_series_uuid WHERE c.crdc_series_uuid IS NOT NULL AND kind = 'copy' GROUP BY ALL"""


CAP_BYTES = 6e9
# Every order is on a side by its customer; some customers are on both.
SIDE_LEFT, SIDE_RIGHT = "o_custkey % 3 > 0 OR o_custkey % 11 = 0", "o_custkey % 3 = 0 OR o_custkey % 13 = 0"


def _two_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf, "orders").withColumn("patient_id", F.col("o_custkey").cast("string"))
    return o.filter(F.expr(SIDE_LEFT)), o.filter(F.expr(SIDE_RIGHT))


def _wrong(spark, sf) -> DataFrame:
    predictions = load(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id")).distinct()
    return S.wrong_split_ids(predictions, _stratified(spark, sf), "test")


def _meta(spark, sf) -> DataFrame:
    s = _series(spark, sf)
    volumes = s.select(F.col("patient_id").alias("patient"), "study_date", "study_year", "round", "kernel", "series_uid",
                       F.col("instance_count").alias("depth"), F.lit(512).alias("rows"), F.lit(512).alias("cols"),
                       F.coalesce("slice_mm", F.lit(1.0)).alias("spacing_z"), F.lit(0.75).alias("spacing_y"), F.lit(0.5).alias("spacing_x"),
                       F.lit(-1024).alias("hu_min"), F.lit(400).alias("hu_max"), F.expr("CAST(series_uid AS BIGINT) % 2 = 0").alias("head_first"))
    m = P.viewer_meta(volumes, F.col("depth") * 4096)
    return C.viewer_order(m.select(
        "id", "patient", "study_date", "visit", "round", "kernel", "kernel_style", "series_uid", "split", "head_first", "file", "mask_file",
        F.array_join("shape", ",").alias("shape"), F.array_join("hu_range", ",").alias("hu_range"),
        F.round(F.get("spacing", F.lit(0)), 6).alias("spacing_z"), F.round("lung_volume_ml", 1).alias("lung_volume_ml")))


META_SQL = f"""WITH {B.PRIMARY_SQL}, m AS (SELECT *, concat_ws('_', patient_id, coalesce(study_date, 'NA'), coalesce(kernel, 'NA'), right(series_uid, 6)) AS id FROM series)
SELECT id, patient_id AS patient, CASE WHEN study_date IS NULL THEN '' ELSE substr(study_date, 1, 4) || '-' || substr(study_date, 5, 2) || '-' || substr(study_date, 7, 2) END AS study_date,
  study_year AS visit, round, coalesce(kernel, '') AS kernel, kernel_style, series_uid, {B.duck_split('patient_id')} AS split, CAST(series_uid AS BIGINT) % 2 = 0 AS head_first,
  id || '/hu' AS file, id || '/lung' AS mask_file, instance_count || ',512,512' AS shape, '-1024,400' AS hu_range, coalesce(slice_mm, 1.0) AS spacing_z,
  round_even(instance_count * 4096 * (coalesce(slice_mm, 1.0::DOUBLE) * 0.75::DOUBLE * 0.5::DOUBLE / 1000.0::DOUBLE), 1) AS lung_volume_ml FROM m"""


def _lookup_patient(spark, sf) -> DataFrame:
    """The primary series of the patient with the most rounds."""
    s = _series(spark, sf)
    most = C.rounds_per_patient(s).orderBy(F.desc("n_rounds"), "patient_id").first()["patient_id"]
    return C.patient_series(s, most).select("patient_id", "round_key", "series_uid", "kernel", "instance_count")


def _overview(spark, sf) -> DataFrame:
    s = _series(spark, sf)
    cached = load(spark, sf, "lineitem").filter("l_shipdate < timestamp'1997-01-01'").select(F.col("l_orderkey").cast("string").alias("series_uid"))
    return C.patient_overview(s, cached).select("patient_id", "split", "n_rounds", "n_series", *[F.round(c, 4).alias(c) for c in ("total_mb", "primary_mb", "cached_mb")])


def _rounds(spark, sf) -> DataFrame:
    screening = load(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("patient_id"), F.explode(F.array(F.lit("T0"), F.lit("T1"))).alias("round"),
        F.col("c_mktsegment").alias("screen_result"), F.col("c_nationkey").cast("bigint").alias("screen_days"))
    return C.patient_rounds(_series(spark, sf), screening).select(
        "patient_id", "round_name", "study_date", "series_uid", "kernel", "kernel_style", "slice_mm", "instance_count",
        F.round("series_size_mb", 4).alias("size_mb"), "alternate_reconstructions", "screen_result", "screen_days")


def _listing(spark, sf) -> DataFrame:
    return C.cohort_listing(_split_table(spark, sf, False), split="train", limit=None, min_rounds=2, query="1", label=0)


def _choose(spark, sf) -> DataFrame:
    return C.choose_patient(_split_table(spark, sf, False), seed=7, split="test", min_rounds=2).select("patient_id", "n_rounds")


def _value(spark, sf) -> DataFrame:
    pid = F.col("patient_id")
    return _patients(spark, sf).select("patient_id", H.split_value(pid).alias("value"), H.assign_split(pid).alias("split"),
                                       H.assign_split(pid, "nlst-v2", (0.5, 0.25, 0.25)).alias("split_v2"))


def _description(spark, sf) -> DataFrame:
    return B.index(spark, sf).withColumn("_f", D.description_fields(F.col("series_description"))).select(
        "series_uid", D.parse_description(F.col("series_description"), F.col("_f")).alias("d")).select("series_uid", "d.*")


_ANNOTATE_COLS = ["series_uid", "patient_id", "study_year", "round", "kernel", "kernel_style", "slice_mm", "is_axial", "round_key"]

QUERIES = {
    "index_scan": (lambda s, d: C.usable(B.index(s, d), "CT", B.MIN_SLICES).select("series_uid", "patient_id", "modality", "instance_count"),
                   f"WITH {B.INDEX_SQL} SELECT series_uid, patient_id, modality, instance_count FROM idx WHERE modality = 'CT' AND instance_count >= {B.MIN_SLICES}"),
    "parse_series_description": (_description, f"""WITH {B.ANNOTATED_SQL} SELECT series_uid, {B.duck_strip("coalesce(series_description, '')")} AS raw, study_year, kind,
        maker AS manufacturer, model, kernel, fov_mm, slice_mm, kvp, ma FROM annotated"""),
    "annotate_series": (lambda s, d: _annotated(s, d).select(*_ANNOTATE_COLS, D.kernel_rank(F.col("kernel_style")).alias("kernel_rank")),
                        f"""WITH {B.ANNOTATED_SQL} SELECT {', '.join(_ANNOTATE_COLS)}, CASE kernel_style WHEN 'smooth' THEN 0 WHEN 'other' THEN 1 ELSE 2 END AS kernel_rank FROM annotated"""),
    "select_primary": (lambda s, d: C.select_primary(C.usable(_annotated(s, d), "CT", 0)).select("series_uid", "patient_id", "round_key", "is_primary"),
                       f"""WITH {B.PRIMARY_SQL.replace(f'AND instance_count >= {B.MIN_SLICES} AND is_axial', '')} SELECT series_uid, patient_id, round_key, is_primary FROM series"""),
    "build_cohort": (lambda s, d: _series(s, d).select(*_ANNOTATE_COLS, "instance_count", "is_primary"),
                     f"WITH {B.PRIMARY_SQL} SELECT {', '.join(_ANNOTATE_COLS)}, instance_count, is_primary FROM series"),
    "limit_patients": (lambda s, d: C.first_patients(_annotated(s, d), 50).select("series_uid", "patient_id"),
                       f"WITH {B.INDEX_SQL} SELECT series_uid, patient_id FROM idx WHERE patient_id IN (SELECT DISTINCT patient_id FROM idx ORDER BY 1 LIMIT 50)"),
    "rounds_per_patient": (lambda s, d: C.rounds_per_patient(_series(s, d)), f"WITH {ROUNDS_SQL} SELECT * FROM patients"),
    "cohort_summary": (lambda s, d: C.cohort_summary(_series(s, d)).withColumn("total_tb", F.round("total_tb", 6)),
                       f"""WITH {B.PRIMARY_SQL} SELECT count(*) AS series, count(*) FILTER (is_primary) AS primary_series, count(DISTINCT patient_id) AS patients,
                       count(DISTINCT study_uid) AS studies, round(sum(series_size_mb) / 1e6, 6) AS total_tb FROM series"""),
    "round_histogram": (lambda s, d: C.round_histogram(_series(s, d)), f"WITH {B.PRIMARY_SQL} SELECT round, count(*) AS series FROM series WHERE is_primary AND round IS NOT NULL GROUP BY 1"),
    "rounds_per_patient_histogram": (lambda s, d: C.rounds_per_patient_histogram(_series(s, d)), f"WITH {ROUNDS_SQL} SELECT n_rounds, count(*) AS patients FROM patients GROUP BY 1"),
    "alternate_reconstructions": (lambda s, d: C.with_alternates(_series(s, d)).select("patient_id", "round_key", "series_uid", "alternate_reconstructions"),
                                  f"""WITH {B.PRIMARY_SQL} SELECT patient_id, round_key, series_uid, others AS alternate_reconstructions FROM
                                  (SELECT *, count(*) FILTER (NOT is_primary) OVER (PARTITION BY patient_id, round_key) AS others FROM series) WHERE is_primary"""),
    "consecutive_pairs": (lambda s, d: C.fits_together(C.consecutive_pairs(_series(s, d)), CAP_BYTES).select(
        "patient_id", "from_round", "to_round", "earlier_series_uid", "later_series_uid", F.round("pair_bytes", -2).alias("pair_bytes"), "fits"),
        f"""WITH {B.PRIMARY_SQL}, led AS (SELECT patient_id, round_key AS from_round, lead(round_key) OVER w AS to_round, series_uid AS earlier_series_uid,
            lead(series_uid) OVER w AS later_series_uid, (series_size_mb + lead(series_size_mb) OVER w) * 1e6::DOUBLE AS b FROM series WHERE is_primary WINDOW w AS (PARTITION BY patient_id ORDER BY round_key))
            SELECT * EXCLUDE (b), round(b, -2) AS pair_bytes, b <= {CAP_BYTES} AS fits FROM led WHERE to_round IS NOT NULL"""),
    "neighbour_rounds": (lambda s, d: C.neighbour_rounds(_series(s, d)),
                         f"""WITH {B.PRIMARY_SQL} SELECT patient_id, series_uid, round, lag(round) OVER w AS previous_round, lead(round) OVER w AS next_round
                         FROM series WHERE is_primary AND round IS NOT NULL WINDOW w AS (PARTITION BY patient_id ORDER BY round)"""),
    "latest_round": (lambda s, d: C.latest_round(_series(s, d)),
                     f"WITH {B.PRIMARY_SQL} SELECT patient_id, max(round_key) AS round_key, arg_max(series_uid, round_key) AS series_uid FROM series WHERE is_primary GROUP BY 1"),
    "download_progress": (lambda s, d: C.download_progress(_series(s, d)).select(
        "patient_id", "round_key", "series_uid", F.round("done_mb", 4).alias("done_mb"), F.round("total_mb", 4).alias("total_mb"), F.round("progress", 9).alias("progress")),
        f"""WITH {B.PRIMARY_SQL}, r AS (SELECT patient_id, round_key, series_uid, sum(series_size_mb) OVER (PARTITION BY patient_id ORDER BY round_key, series_uid) AS d,
            sum(series_size_mb) OVER (PARTITION BY patient_id) AS t FROM series)
            SELECT patient_id, round_key, series_uid, round(d, 4) AS done_mb, round(t, 4) AS total_mb, round(d / greatest(t, 1), 9) AS progress FROM r"""),
    "patient_series": (_lookup_patient, f"""WITH {ROUNDS_SQL} SELECT patient_id, round_key, series_uid, kernel, instance_count FROM series WHERE is_primary
        AND patient_id = (SELECT patient_id FROM patients ORDER BY n_rounds DESC, patient_id LIMIT 1)"""),
    "patient_overview": (_overview, f"""WITH {B.PRIMARY_SQL}, have AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS series_uid, true AS c FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')
        SELECT patient_id, {B.duck_split('patient_id')} AS split, count(*) FILTER (is_primary) AS n_rounds, count(*) AS n_series, round(sum(series_size_mb), 4) AS total_mb,
        round(coalesce(sum(series_size_mb) FILTER (is_primary), 0), 4) AS primary_mb, round(coalesce(sum(series_size_mb) FILTER (is_primary AND c), 0), 4) AS cached_mb
        FROM series LEFT JOIN have USING (series_uid) GROUP BY patient_id"""),
    "patient_rounds": (_rounds, f"""WITH {B.PRIMARY_SQL}, a AS (SELECT *, count(*) FILTER (NOT is_primary) OVER (PARTITION BY patient_id, round_key) AS others FROM series),
        reads AS (SELECT CAST(c_custkey AS VARCHAR) AS patient_id, r AS round_name, c_mktsegment AS screen_result, c_nationkey AS screen_days FROM customer, (SELECT unnest(['T0', 'T1']) AS r))
        SELECT a.patient_id, coalesce(round, round_key) AS round_name, study_date, series_uid, kernel, kernel_style, slice_mm, instance_count, round(series_size_mb, 4) AS size_mb,
        others AS alternate_reconstructions, screen_result, screen_days FROM a LEFT JOIN reads ON reads.patient_id = a.patient_id AND reads.round_name = coalesce(round, round_key) WHERE is_primary"""),
    "cohort_listing": (_listing, f"{SPLIT_TABLE_SQL} SELECT patient_id, split, n_rounds, label, label_source FROM pure WHERE split = 'train' AND n_rounds >= 2 AND contains(patient_id, '1') AND label = 0"),
    "cohort_listing_without_splits": (lambda s, d: C.cohort_listing(C.listing_without_splits(_series(s, d)), limit=50),
                                      f"WITH {ROUNDS_SQL} SELECT patient_id, {B.duck_split('patient_id')} AS split, n_rounds, -1 AS label, 'none' AS label_source FROM patients ORDER BY patient_id LIMIT 50"),
    "choose_patient": (_choose, f"{SPLIT_TABLE_SQL} SELECT patient_id, n_rounds FROM pure WHERE split = 'test' AND n_rounds >= 2 ORDER BY sha256('7:' || patient_id), patient_id LIMIT 1"),
    "sample_series": (lambda s, d: C.sample_series(B.index(s, d).filter("modality = 'CT'"), 25, "series_uid", seed=0).select("series_uid", "patient_id"),
                      f"WITH {B.INDEX_SQL} SELECT series_uid, patient_id FROM idx WHERE modality = 'CT' ORDER BY sha256('0:' || series_uid), series_uid LIMIT 25"),
    "enough_slices": (lambda s, d: C.enough_slices(load(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("series_uid")), 3),
                      "SELECT CAST(l_orderkey AS VARCHAR) AS series_uid, count(*) AS n_slices FROM lineitem GROUP BY 1 HAVING count(*) >= 3"),
    "not_yet_processed": (lambda s, d: C.not_yet_processed(B.index(s, d), load(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("series_uid"))).select("series_uid", "patient_id"),
                          f"WITH {B.INDEX_SQL} SELECT series_uid, patient_id FROM idx WHERE series_uid NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)"),
    "viewer_index": (_meta, META_SQL),
    "patient_bundle": (lambda s, d: P.patient_bundle(_series(s, d)).select("patient_id", "split", F.array_join("rounds", ",").alias("rounds"), "n_series", F.round("mb", 4).alias("mb")),
                       f"""WITH {B.PRIMARY_SQL} SELECT patient_id, {B.duck_split('patient_id')} AS split, coalesce(string_agg(DISTINCT round, ',' ORDER BY round), '') AS rounds,
                       count(*) AS n_series, round(sum(series_size_mb), 4) AS mb FROM series WHERE is_primary GROUP BY patient_id"""),
    "manifest_lines": (lambda s, d: M.classify_lines(_raw_lines(s, d)).groupBy("kind", "line", "crdc_series_uuid").agg(F.count(F.lit(1)).alias("lines")),
                       f"WITH {LINES_SQL} SELECT kind, line, crdc_series_uuid, count(*) AS lines FROM classified GROUP BY ALL"),
    "manifest_unreadable": (lambda s, d: M.unreadable_lines(M.classify_lines(_raw_lines(s, d))).select("k", "line"),
                            f"WITH {LINES_SQL} SELECT k, line FROM classified WHERE kind = 'copy' AND crdc_series_uuid IS NULL"),
    "manifest_lookup": (_lookup(True), _lookup_sql("LEFT")),
    "manifest_cohort": (_lookup(False), _lookup_sql("INNER")),
    "split_value": (_value, f"""SELECT CAST(c_custkey AS VARCHAR) AS patient_id, {B.duck_bucket('CAST(c_custkey AS VARCHAR)')} / 10000.0::DOUBLE AS value, {B.duck_split('CAST(c_custkey AS VARCHAR)')} AS split,
        CASE WHEN b < 5000 THEN 'train' WHEN b < 7500 THEN 'val' ELSE 'test' END AS split_v2 FROM (SELECT *, {B.duck_bucket('CAST(c_custkey AS VARCHAR)', 'nlst-v2')} AS b FROM customer)"""),
    "stratified_split": (_stratified, f"""WITH hashed AS (SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_mktsegment, {B.duck_bucket('CAST(c_custkey AS VARCHAR)')} AS bucket FROM customer),
        {STRATA_SQL.format(s='c_mktsegment')} SELECT patient_id, c_mktsegment, split, 'stratified' AS split_mode, 'nlst-v1' AS split_seed FROM stratified"""),
    "build_splits": (lambda s, d: _split_table(s, d, False), f"{SPLIT_TABLE_SQL} SELECT patient_id, split, label, label_source, n_rounds, n_series, 'hash' AS split_mode, 'nlst-v1' AS split_seed FROM pure"),
    "build_splits_stratified": (lambda s, d: _split_table(s, d, True), f"{SPLIT_TABLE_SQL} SELECT patient_id, split, label, label_source, n_rounds, n_series, 'stratified' AS split_mode, 'nlst-v1' AS split_seed FROM stratified"),
    "split_summary": (_summary, f"{SPLIT_TABLE_SQL} {SUMMARY_SQL.format(t='stratified')}"),
    "duplicate_ids": (lambda s, d: S.duplicate_ids(load(s, d, "lineitem"), "l_orderkey").select("l_orderkey", "rows"), "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1"),
    "unexpected_splits": (lambda s, d: S.unexpected_splits(load(s, d, "orders").select(F.col("o_orderstatus").alias("split")), ["F", "O"]), "SELECT DISTINCT o_orderstatus AS split FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL"),
    "leaked_patients": (lambda s, d: S.shared_ids(*_two_sides(s, d)), f"SELECT CAST(o_custkey AS VARCHAR) AS patient_id FROM orders WHERE {SIDE_LEFT} INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE {SIDE_RIGHT}"),
    "wrong_split_ids": (_wrong, f"""WITH hashed AS (SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_mktsegment, {B.duck_bucket('CAST(c_custkey AS VARCHAR)')} AS bucket FROM customer),
        {STRATA_SQL.format(s='c_mktsegment')} SELECT patient_id, split FROM stratified WHERE split <> 'test' AND patient_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)"""),
    "merge_labels": (lambda s, d: L.merge_labels(_patients(s, d), *_label_tables(s, d)),
                     f"WITH {LABEL_TABLES_SQL} SELECT CAST(c_custkey AS VARCHAR) AS patient_id, coalesce(label, -1) AS label, coalesce(label_source, 'none') AS label_source FROM customer LEFT JOIN merged ON merged.patient_id = CAST(c_custkey AS VARCHAR)"),
}

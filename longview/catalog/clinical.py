"""Registered queries over label texts and coded clinical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.functions import outcome as O
from longview.operators import clinical as K
from longview.operators import labels as L
from longview.sources.tables import canonical_labels

from . import base as B
from .base import load, splits
from .cohort import LABEL_TABLES_SQL, _label_tables, _patients

# Label texts of every kind, by order line.
RAW_LABEL = """CASE l_linenumber % 7 WHEN 0 THEN ' YES ' WHEN 1 THEN CAST(l_suppkey % 4 AS VARCHAR(9)) WHEN 2 THEN '0.0' WHEN 3 THEN '.'
  WHEN 4 THEN 'negative' WHEN 5 THEN CASE WHEN l_partkey % 2 = 0 THEN '-1' ELSE 'abc' END ELSE CASE WHEN l_partkey % 3 = 0 THEN '2.5' ELSE 'Unknown' END END"""
FILE_STEM = """CASE l_suppkey % 6 WHEN 0 THEN 'CDAS_extract' WHEN 1 THEN 'nlst-idc' WHEN 2 THEN 'nlstseg_v1' WHEN 3 THEN 'boxes.sybil' WHEN 4 THEN 'none_known' ELSE 'hospital' END"""


def duck_label(c: str, year: bool = False) -> str:
    t = f"lower({B.duck_strip(c)})"
    n = B.duck_number(t)
    zero = "" if year else f"WHEN ({n}) = 0 THEN 0 "
    return f"""CASE WHEN {t} IN ('1','yes','y','true','positive','cancer') THEN 1 WHEN {t} IN ('0','no','n','false','negative') THEN 0
      WHEN {t} IN ('','na','nan','null','unknown','.') THEN -1 {zero}WHEN ({n}) {'>=' if year else '>'} 0 THEN 1 ELSE -1 END"""


def _coerce(spark, sf) -> DataFrame:
    raw = load(spark, sf, "lineitem").select(F.expr(RAW_LABEL).alias("raw"))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("rows")).select(
        "raw", "rows", O.coerce_label(F.col("raw")).alias("label"), O.coerce_label(F.col("raw"), True).alias("label_year_coded"))


def _sources(spark, sf) -> DataFrame:
    stem = load(spark, sf, "lineitem").select(F.expr(FILE_STEM).alias("stem"))
    found = stem.withColumn("source", O.infer_source(F.col("stem"))).withColumn("source_rank", O.source_rank(F.col("source")))
    return found.groupBy("stem", "source", "source_rank").agg(F.count(F.lit(1)).alias("rows"))


SOURCES_SQL = f"""SELECT stem, source, CASE source WHEN 'cdas' THEN 0 WHEN 'idc' THEN 1 WHEN 'nlstseg' THEN 2 WHEN 'sybil' THEN 3 WHEN 'manual' THEN 4 WHEN 'none' THEN 5 ELSE 6 END AS source_rank,
  count(*) AS rows FROM (SELECT stem, CASE WHEN contains(lower(stem), 'cdas') THEN 'cdas' WHEN contains(lower(stem), 'idc') THEN 'idc' WHEN contains(lower(stem), 'nlstseg') THEN 'nlstseg'
  WHEN contains(lower(stem), 'sybil') THEN 'sybil' WHEN contains(lower(stem), 'manual') THEN 'manual' WHEN contains(lower(stem), 'none') THEN 'none' ELSE 'manual' END AS source
  FROM (SELECT {FILE_STEM} AS stem FROM lineitem)) GROUP BY ALL"""


def _canonical(spark, sf) -> DataFrame:
    raw = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("PID"), F.expr(RAW_LABEL).alias("Confirmed"), "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return canonical_labels(raw, "manual", ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])


CANONICAL_SQL = f"""SELECT patient_id, {duck_label('raw')} AS label, 'manual' AS label_source FROM (SELECT CAST(l_orderkey AS VARCHAR) AS patient_id, {RAW_LABEL} AS raw,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS i FROM lineitem) WHERE i = 1"""


def _codes(spark, sf) -> DataFrame:
    return K.dictionary_codes(B.dictionary(spark, sf)).select("short_table_name", F.col("column").alias("col"), "code", "text")


def _decoded(spark, sf) -> DataFrame:
    cols = [*B.CODE_COLUMNS, *B.REGION_COLUMNS, "de_type", "lesionsize"]
    long = B.participants(spark, sf).select("pid", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("e")).select(
        "pid", F.lit("nlst_prsn").alias("short_table_name"), "e.column", "e.value")
    return K.decode(long, K.dictionary_codes(B.dictionary(spark, sf))).select("pid", F.col("column").alias("col"), "value", "decoded")


def _histology_case(code: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v} (ICD-O-3 {k})'" for k, v in O.HISTOLOGY.items())
    return f"CASE {code} {whens} END"


LONG_SQL = f"""{B.PARTICIPANTS_SQL}, {B.DICTIONARY_SQL},
long AS (SELECT pid, col, value FROM (SELECT pid, {', '.join(c for c in B.CODED)} FROM participants) UNPIVOT INCLUDE NULLS (value FOR col IN ({', '.join(B.CODED)}))),
decoded AS (SELECT pid, l.col, value, CASE WHEN NOT {B.duck_missing('value')} THEN coalesce(CASE WHEN l.col IN ('de_type', 'de_type_7thed') THEN {_histology_case(B.duck_strip('value'))} END,
  text, {B.duck_strip('value')}) END AS decoded FROM long l LEFT JOIN codes c ON c.col = l.col AND c.code = {B.duck_strip('value')} AND NOT {B.duck_missing('value')})"""
_DECODE_COLS = ", ".join(f"'{c}'" for c in [*B.CODE_COLUMNS, *B.REGION_COLUMNS, "de_type", "lesionsize"])

OUTCOMES_SQL = f"""{B.PARTICIPANTS_SQL}, outcomes AS (SELECT pid AS patient_id, CASE WHEN {B.duck_missing('candx_days')} THEN 0 ELSE 1 END AS label, 'idc' AS label_source,
  {B.duck_int('candx_days')} AS days_to_diagnosis, {B.duck_int('canc_free_days')} AS cancer_free_days, {B.duck_int('cancyr')} AS diagnosis_study_year FROM participants)"""


def _outcomes(spark, sf) -> DataFrame:
    return K.outcomes(B.participants(spark, sf), ["c_custkey"])


def _labels_of_columns(spark, sf) -> DataFrame:
    known = K.dictionary_labels(B.dictionary(spark, sf))
    return known.select(F.col("column").alias("col"), O.column_label(F.col("column"), F.col("column_label")).alias("shown"))


def _units(spark, sf) -> DataFrame:
    p = B.participants(spark, sf)
    return p.select("pid", O.with_units(F.lit("age"), F.col("age")).alias("age"), O.with_units(F.lit("lesionsize"), F.col("lesionsize")).alias("lesionsize"),
                    O.with_units(F.lit("race"), F.col("race")).alias("race"), O.histology(F.col("de_type")).alias("histology"),
                    O.years_to_diagnosis(O.as_int(F.col("candx_days"))).alias("years"))


def _records(spark, sf) -> DataFrame:
    d = B.dictionary(spark, sf)
    return K.patient_records(B.participants(spark, sf), K.dictionary_codes(d), K.dictionary_labels(d), ["c_custkey"])


def _flat_records(spark, sf) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["label"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), "|")
    return _records(spark, sf).select(
        "patient_id", "label", "outcome.days_to_diagnosis", F.col("outcome.diagnosis_study_year").alias("year"),
        F.col("outcome.screen_result_at_diagnosis").alias("screen"), text("demographics").alias("demographics"), text("tumour").alias("tumour"),
        F.array_join("locations", ", ").alias("locations"),
        F.array_join(F.transform("screening", lambda r: F.concat(r["round"], F.lit("="), F.coalesce(r["result"], F.lit("-")), F.lit("@"),
                                                                 F.coalesce(r["days_from_randomisation"].cast("string"), F.lit("?")))), "|").alias("screening"))


def _shown(col: str) -> str:
    label = O.LABEL_OVERRIDES.get(col) or (f"{col} code" if col in [*B.CODE_COLUMNS, *B.REGION_COLUMNS] else col)
    unit = O.COLUMN_UNITS.get(col)
    value = f"max(decoded) FILTER (col = '{col}')"
    if unit:
        value = f"CASE WHEN contains({value}, '{unit}') THEN {value} ELSE {value} || ' {unit}' END"
    return f"'{label}=' || {{}}".format(f"coalesce({value}, '-')")


def _value(col: str) -> str:
    return f"max(decoded) FILTER (col = '{col}')"


_DX = f"NOT {B.duck_missing('candx_days')}"
_TUMOUR = [c for c in K.TUMOUR if c in B.CODED]
RECORDS_SQL = f"""WITH {LONG_SQL}, wide AS (SELECT pid, {', '.join(f"{_value(c)} AS d_{c}" for c in B.CODED)},
  concat_ws('|', {', '.join(_shown(c) for c in K.DEMOGRAPHICS)}) AS demographics,
  concat_ws('|', {', '.join(f"CASE WHEN {_value(c)} IS NOT NULL THEN {_shown(c)} END" for c in _TUMOUR)}) AS tumour FROM decoded GROUP BY pid),
sites AS (SELECT *, concat_ws(', ', CASE WHEN {B.duck_strip('loclup')} IN ('1', '1.0', 'True') THEN 'left upper lobe' END, CASE WHEN {B.duck_strip('locrmid')} IN ('1', '1.0', 'True') THEN 'right middle lobe' END,
  CASE WHEN {B.duck_strip('loccar')} IN ('1', '1.0', 'True') THEN 'carina' END) AS sites FROM participants)
SELECT pid AS patient_id, CASE WHEN {_DX} THEN 1 ELSE 0 END AS label, {B.duck_int('candx_days')} AS days_to_diagnosis, d_cancyr AS year, d_can_scr AS screen, demographics,
  CASE WHEN {_DX} THEN tumour ELSE '' END AS tumour, CASE WHEN {_DX} THEN sites ELSE '' END AS locations,
  concat_ws('|', CASE WHEN d_scr_res0 IS NOT NULL OR NOT {B.duck_missing('scr_days0')} THEN 'T0=' || coalesce(d_scr_res0, '-') || '@' || coalesce(CAST({B.duck_int('scr_days0')} AS VARCHAR), '?') END,
    CASE WHEN d_scr_res1 IS NOT NULL OR NOT {B.duck_missing('scr_days1')} THEN 'T1=' || coalesce(d_scr_res1, '-') || '@' || coalesce(CAST({B.duck_int('scr_days1')} AS VARCHAR), '?') END) AS screening
FROM sites JOIN wide USING (pid)"""


def _lines_sql() -> str:
    """Display lines of every record."""
    dx, days = _DX, B.duck_int("candx_days")
    entry = lambda c: _shown(c).replace("=' ||", ": ' ||")
    present = lambda c: f"CASE WHEN {_value(c)} <> '' THEN {entry(c)} END"
    day = lambda k: f"lpad(coalesce(CAST({B.duck_int(f'scr_days{k}')} AS VARCHAR), '?'), 4, ' ')"
    read = lambda k: f"""CASE WHEN d_scr_res{k} IS NOT NULL OR NOT {B.duck_missing(f'scr_days{k}')} THEN '  T{k}          day ' || {day(k)} || '  ' || coalesce(d_scr_res{k}, '—') END"""
    return f"""WITH {LONG_SQL}, wide AS (SELECT pid, {', '.join(f"{_value(c)} AS d_{c}" for c in B.CODED)},
      concat_ws(' · ', {', '.join(present(c) for c in K.DEMOGRAPHICS)}) AS person, concat_ws(' · ', {', '.join(present(c) for c in _TUMOUR)}) AS tumour FROM decoded GROUP BY pid)
    SELECT patient_id, text FROM (SELECT p.pid AS patient_id, concat_ws(chr(10), 'Patient ' || p.pid,
      CASE WHEN {dx} THEN regexp_replace('  OUTCOME     lung cancer diagnosed — ' || coalesce('study year ' || d_cancyr, '') || ', ' ||
        CASE WHEN round({days} / 365.25::DOUBLE, 2) <> 0 THEN CAST(round({days} / 365.25::DOUBLE, 2) AS VARCHAR) || ' years from randomisation' ELSE '' END, '[, ]+$', '')
      ELSE '  OUTCOME     no lung-cancer diagnosis on record' || CASE WHEN {B.duck_int('canc_free_days')} <> 0 THEN ' over ' || format('{{:.1f}}', {B.duck_int('canc_free_days')} / 365.25::DOUBLE) || ' years of follow-up' ELSE '' END END,
      CASE WHEN {dx} AND d_can_scr <> '' THEN '              screen at diagnosis: ' || d_can_scr END,
      CASE WHEN {dx} AND tumour <> '' THEN '  TUMOUR      ' || tumour END, CASE WHEN person <> '' THEN '  PERSON      ' || person END,
      CASE WHEN {dx} AND sites <> '' THEN '  LOCATION    ' || sites END, {read(0)}, {read(1)}) AS text
    FROM (SELECT *, concat_ws(', ', CASE WHEN {B.duck_strip('loclup')} = '1' THEN 'left upper lobe' END, CASE WHEN {B.duck_strip('locrmid')} = '1.0' THEN 'right middle lobe' END,
      CASE WHEN {B.duck_strip('loccar')} = '1' THEN 'carina' END) AS sites FROM participants) p JOIN wide w ON w.pid = p.pid)"""


def _mismatch(spark, sf) -> DataFrame:
    pid = F.when(F.expr("c_acctbal < 500 and c_custkey % 10 <> 0"), F.col("c_custkey")).otherwise(-1 - F.col("c_custkey"))  # no such participant
    cancers = load(spark, sf, "customer").select(pid.cast("string").alias("pid"))
    return K.flag_mismatches(B.participants(spark, sf), cancers)


def _parts(spark, sf) -> DataFrame:
    a = load(spark, sf, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("pid"), "c_nationkey")
    b = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("pid").cast("string"), F.col("s_name").alias("name"))
    return K.union_parts(a, b)


def _first(spark, sf) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return L.keep_first(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


def _merged(spark, sf) -> DataFrame:
    return L.merge_labels(_patients(spark, sf), *_label_tables(spark, sf))


MERGED_SQL = f"""WITH {LABEL_TABLES_SQL}, t AS (SELECT coalesce(label, -1) AS label, coalesce(label_source, 'none') AS label_source
  FROM customer LEFT JOIN merged ON merged.patient_id = CAST(c_custkey AS VARCHAR))"""

QUERIES = {
    "coerce_label": (_coerce, f"SELECT raw, count(*) AS rows, {duck_label('raw')} AS label, {duck_label('raw', True)} AS label_year_coded FROM (SELECT {RAW_LABEL} AS raw FROM lineitem) GROUP BY raw"),
    "label_sources": (_sources, SOURCES_SQL),
    "read_labels": (_canonical, CANONICAL_SQL),
    "keep_first": (_first, """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS i
        FROM lineitem) WHERE i = 1"""),
    "label_summary": (lambda s, d: L.label_summary(_merged(s, d)).withColumn("positive_rate", F.round("positive_rate", 9)),
                      f"""{MERGED_SQL} SELECT count(*) AS patients, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, count(*) FILTER (label = -1) AS unknown,
                      round(count(*) FILTER (label = 1) / nullif(count(*) FILTER (label >= 0), 0), 9) AS positive_rate FROM t"""),
    "label_source_counts": (lambda s, d: L.source_counts(_merged(s, d)), f"{MERGED_SQL} SELECT label_source, count(*) AS patients FROM t GROUP BY 1"),
    "known_labels_only": (lambda s, d: L.known_only(splits(s, d)), f"WITH {B.SPLITS_SQL} SELECT * FROM splits WHERE label >= 0"),
    "outcomes_in_cohort": (lambda s, d: L.restrict_to_cohort(_outcomes(s, d), load(s, d, "orders").select(F.col("o_custkey").cast("string").alias("patient_id"))).select("patient_id", "label", "label_source"),
                           f"WITH {OUTCOMES_SQL} SELECT patient_id, label, label_source FROM outcomes WHERE patient_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)"),
    "dictionary_codes": (_codes, f"WITH {B.DICTIONARY_SQL} SELECT * FROM codes"),
    "decode": (_decoded, f"WITH {LONG_SQL} SELECT * FROM decoded WHERE col IN ({_DECODE_COLS})"),
    "coded_numbers": (lambda s, d: B.participants(s, d).select("pid", *[O.as_int(F.col(c)).alias(c) for c in ("candx_days", "canc_free_days", "lesionsize", "cigsmok")],
                                                               O.is_missing(F.col("canc_free_days")).alias("missing")),
                      f"WITH {B.PARTICIPANTS_SQL} SELECT pid, {', '.join(f'{B.duck_int(c)} AS {c}' for c in ('candx_days', 'canc_free_days', 'lesionsize', 'cigsmok'))}, {B.duck_missing('canc_free_days')} AS missing FROM participants"),
    "column_labels": (_labels_of_columns, "SELECT col, CASE col WHEN 'cigsmok' THEN 'Smoking at T0' WHEN 'de_stag' THEN 'Stage (AJCC 6)' ELSE col || ' code' END AS shown FROM ("
                      f"SELECT DISTINCT col FROM (WITH {B.DICTIONARY_SQL} SELECT * FROM codes))"),
    "display_values": (_units, f"""WITH {B.PARTICIPANTS_SQL} SELECT pid, age || ' years' AS age, lesionsize || ' mm' AS lesionsize, race, {_histology_case(B.duck_strip('de_type'))} AS histology,
        round({B.duck_int('candx_days')} / 365.25::DOUBLE, 2) AS years FROM participants"""),
    "outcomes": (_outcomes, f"WITH {OUTCOMES_SQL} SELECT * FROM outcomes"),
    "outcome_summary": (lambda s, d: K.outcome_summary(_outcomes(s, d)), f"""WITH {OUTCOMES_SQL} SELECT count(*) AS patients, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative,
        round_even(count(*) FILTER (label = 1) / count(*), 4) AS positive_rate, CAST(trunc(median(cancer_free_days)) AS BIGINT) AS median_follow_up_days FROM outcomes"""),
    "diagnosis_years": (lambda s, d: K.diagnosis_years(_outcomes(s, d)), f"WITH {OUTCOMES_SQL} SELECT diagnosis_study_year, count(*) AS patients FROM outcomes WHERE label = 1 AND diagnosis_study_year IS NOT NULL GROUP BY 1"),
    "flag_mismatches": (_mismatch, f"""WITH {B.PARTICIPANTS_SQL}, f AS (SELECT DISTINCT pid FROM participants WHERE {_DX}),
        c AS (SELECT CAST(CASE WHEN c_acctbal < 500 AND c_custkey % 10 <> 0 THEN c_custkey ELSE -1 - c_custkey END AS VARCHAR) AS pid FROM customer)
        SELECT pid, 'cancers' AS missing_from FROM f WHERE pid NOT IN (SELECT pid FROM c) UNION ALL SELECT pid, 'participants' FROM c WHERE pid NOT IN (SELECT pid FROM f)"""),
    "lesion_sites": (lambda s, d: K.lesion_sites(B.participants(s, d)).select("pid", F.array_join("locations", ", ").alias("locations")),
                     f"""WITH {B.PARTICIPANTS_SQL} SELECT pid, concat_ws(', ', CASE WHEN {B.duck_strip('loclup')} = '1' THEN 'left upper lobe' END, CASE WHEN {B.duck_strip('locrmid')} = '1.0' THEN 'right middle lobe' END,
                     CASE WHEN {B.duck_strip('loccar')} = '1' THEN 'carina' END) AS locations FROM participants"""),
    "patient_records": (_flat_records, RECORDS_SQL),
    "format_records": (lambda s, d: K.format_record(_records(s, d)), _lines_sql()),
    "union_parts": (_parts, "SELECT CAST(c_custkey AS VARCHAR) AS pid, c_nationkey, NULL AS name FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, s_name FROM supplier"),
}

"""How the given tables stand in for cohort, clinical and imaging tables.

Each stand-in exists twice: as a DataFrame, and as SQL text for the oracle.
Plain CASE and arithmetic text is shared by both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from longview.functions.hashing import BUCKETS, DEFAULT_SEED, assign_split
from longview.functions.outcome import MISSING_CODES


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- series index

def one_of(key: str, *texts: str) -> str:
    """SQL text that picks one of several texts by a key's remainder."""
    return f"split_part('{';'.join(texts)}', ';', CAST({key} % {len(texts)} AS INT) + 1)"


DESCRIPTION = f"""CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat(
  {one_of('o_orderkey', 'na', '3', ' 1 ', '0.0', '', '2e0', '0', '1', '2', '0', '1')}, ',', {one_of('o_orderkey', 'OPL', ' opa ', *['OPA'] * 15)}, ',',
  {one_of('o_orderkey', 'GE', 'SIEMENS', 'TOSHIBA', 'PHILIPS')}, ',', {one_of('o_orderkey', 'null', 'M1', 'M2', 'M3', 'M4')}, ',',
  {one_of('o_orderkey', 'STANDARD', 'LUNG', 'b30f', 'B50f', 'FC01', 'FC51', 'XYZ', 'na')}, ',360,',
  {one_of('o_orderkey', 'null', '1.5d', '0x1p3', '.5', '1.25', '2', '2.5', '3.', '1_0')}, ',120,80') END"""
MODALITY = "CASE WHEN o_orderkey % 29 = 0 THEN 'MR' ELSE 'CT' END"
UUID = """concat(substr(md5({k}), 1, 8), '-', substr(md5({k}), 9, 4), '-', substr(md5({k}), 13, 4), '-', substr(md5({k}), 17, 4), '-', substr(md5({k}), 21, 12))"""
MIN_SLICES = 2


def uuid_text(key: str) -> str:
    return UUID.format(k=f"CAST({key} AS VARCHAR(20))")


def uuid_of(key: F.Column) -> F.Column:
    return F.regexp_replace(F.md5(key.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def index(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as series: patient is the customer, slices are the order's lines."""
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = load(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").cast("string").alias("series_uid"),
        F.concat(F.lit("S"), F.col("o_custkey").cast("string"), F.lit("-"), F.substring(day, 1, 6)).alias("study_uid"),
        F.when(F.col("o_orderkey") % 53 != 0, day).alias("study_date"), # A stored column in the real index: exploding keeps filters on it from rebuilding the text.
        F.explode(F.array(F.expr(DESCRIPTION))).alias("series_description"), F.expr(MODALITY).alias("modality"), F.coalesce("n", F.lit(0)).alias("instance_count"),
        (F.col("o_totalprice") / 100).alias("series_size_mb"), uuid_of(F.col("o_orderkey")).alias("crdc_series_uuid"))


INDEX_SQL = f"""idx AS (SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS series_uid,
  'S' || o_custkey || '-' || strftime(o_orderdate, '%Y%m') AS study_uid,
  CASE WHEN o_orderkey % 53 <> 0 THEN strftime(o_orderdate, '%Y%m%d') END AS study_date,
  {DESCRIPTION} AS series_description, {MODALITY} AS modality, coalesce(n, 0) AS instance_count,
  o_totalprice / 100 AS series_size_mb, {uuid_text('o_orderkey')} AS crdc_series_uuid
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def duck_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def duck_number(c: str) -> str:
    pattern = r"[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
    return f"CASE WHEN regexp_full_match({c}, '{pattern}') THEN TRY_CAST(replace({c}, '_', '') AS DOUBLE) END"


def duck_field(i: int) -> str:
    v = duck_strip(f"string_split(coalesce(series_description, ''), ',')[{i + 1}]")
    return f"CASE WHEN lower({v}) NOT IN ('', 'na', 'null', 'none', 'nan') THEN {v} END"


STYLE_SQL = """CASE WHEN upper(kernel) IN ('STANDARD','SOFT','A','B','B10F','B20F','B30F','B31F','FC01','FC02','FC03','FC10') THEN 'smooth'
  WHEN upper(kernel) IN ('LUNG','BONE','DETAIL','EDGE','C','D','E','YA','B40F','B45F','B50F','B60F','B70F','B80F','FC30','FC50','FC51','FC52','FC53')
  THEN 'sharp' ELSE 'other' END"""

ANNOTATED_SQL = f"""{INDEX_SQL},
fields AS (SELECT *, {duck_field(0)} AS f0, upper({duck_field(1)}) AS kind, {duck_field(2)} AS maker, {duck_field(3)} AS model,
  {duck_field(4)} AS kernel, {duck_field(5)} AS f5, {duck_field(6)} AS f6, {duck_field(7)} AS f7, {duck_field(8)} AS f8 FROM idx),
parsed AS (SELECT *, CASE WHEN {duck_number('f0')} IN (0, 1, 2) THEN CAST({duck_number('f0')} AS INT) END AS study_year,
  {duck_number('f5')} AS fov_mm, {duck_number('f6')} AS slice_mm, {duck_number('f7')} AS kvp, {duck_number('f8')} AS ma FROM fields),
annotated AS (SELECT *, 'T' || study_year AS round, {STYLE_SQL} AS kernel_style, coalesce(kind = 'OPA', false) AS is_axial,
  coalesce('T' || study_year, 'D' || coalesce(study_date, 'unknown')) AS round_key FROM parsed)"""


def duck_bucket(text: str, seed: str = DEFAULT_SEED) -> str:
    """The hash bucket as SQL: twelve hex digits at a time."""
    digest = f"sha256('{seed}:' || {text})"
    acc = ""
    for start in range(1, 65, 12):
        width = min(12, 65 - start)
        part = f"CAST('0x' || substr({digest}, {start}, {width}) AS BIGINT)"
        acc = f"({part}) % {BUCKETS}" if not acc else f"(({acc}) * {pow(16, width, BUCKETS)} + {part}) % {BUCKETS}"
    return f"({acc})"


def duck_split(text: str, seed: str = DEFAULT_SEED) -> str:
    b = f"{duck_bucket(text, seed)} / 10000.0::DOUBLE"
    return f"CASE WHEN {b} < 0.7::DOUBLE THEN 'train' WHEN {b} < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END"


PRIMARY_SQL = f"""{ANNOTATED_SQL},
series AS (SELECT *, row_number() OVER (PARTITION BY patient_id, round_key ORDER BY is_axial DESC,
  CASE kernel_style WHEN 'smooth' THEN 0 WHEN 'other' THEN 1 WHEN 'sharp' THEN 2 ELSE 3 END, coalesce(slice_mm, 1e9),
  instance_count DESC, {duck_bucket('series_uid', 'series-pick')}, series_uid) = 1 AS is_primary
  FROM annotated WHERE modality = 'CT' AND instance_count >= {MIN_SLICES} AND is_axial)"""


# ------------------------------------------------------------ labels and scores

def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A rising risk curve per document, a function of its length that no length levels off."""
    base = F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))
    return load(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("patient_id"), *[(base * (h + 2) / F.lit(8.0)).alias(f"year_{h}") for h in range(1, 7)])


SCORES_SQL = "scores AS (SELECT CAST(doc_id AS VARCHAR) AS patient_id, " + ", ".join(
    f"n_chars / (n_chars + 2000.0::DOUBLE) * {h + 2} / 8.0::DOUBLE AS year_{h}" for h in range(1, 7)) + " FROM documents)"


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as patients; a toxicity label as outcome, none as unknown."""
    docs = load(spark, sf, "documents").select("doc_id")
    out = docs.join(load(spark, sf, "labels"), "doc_id", "left")
    pid = F.col("doc_id").cast("string")
    # A stored table would hold the split; exploding it keeps filters on it from hashing again.
    return out.select(pid.alias("patient_id"), F.explode(F.array(assign_split(pid))).alias("split"), F.coalesce("toxic", F.lit(-1)).alias("label"),
                      F.when(F.col("toxic").isNull(), "none").when(F.col("quality") == 1, "cdas").otherwise("idc").alias("label_source"))


SPLITS_SQL = f"""splits AS (SELECT CAST(doc_id AS VARCHAR) AS patient_id, {duck_split('CAST(doc_id AS VARCHAR)')} AS split,
  coalesce(toxic, -1) AS label, CASE WHEN toxic IS NULL THEN 'none' WHEN quality = 1 THEN 'cdas' ELSE 'idc' END AS label_source
  FROM documents LEFT JOIN labels USING (doc_id))"""


# ------------------------------------------------------------- clinical tables

CODED = {
    "candx_days": "CASE WHEN c_acctbal < 0 THEN CAST(CAST(floor(-c_acctbal) AS BIGINT) AS VARCHAR(20)) ELSE '.N' END",
    "canc_free_days": "CASE WHEN c_custkey % 37 = 0 THEN ' .M ' ELSE CONCAT(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) + 300 AS VARCHAR(20)), '.7') END",
    "cancyr": "CASE WHEN c_acctbal < 0 THEN CAST(c_custkey % 7 AS VARCHAR(20)) ELSE '.N' END",
    "can_scr": "CASE WHEN c_acctbal < 0 THEN CAST(c_custkey % 5 AS VARCHAR(20)) ELSE '.N' END",
    "age": "CAST(55 + c_custkey % 20 AS VARCHAR(20))",
    "gender": "CAST(1 + c_custkey % 2 AS VARCHAR(20))",
    "race": "CAST(c_nationkey AS VARCHAR(20))",
    "cigsmok": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(c_custkey % 2 AS VARCHAR(20)) END",
    "de_stag": "CAST(c_nationkey % 9 AS VARCHAR(20))",
    "de_type": "CASE c_custkey % 6 WHEN 0 THEN '8140' WHEN 1 THEN ' 8070' WHEN 2 THEN '9999' WHEN 3 THEN '8041' WHEN 4 THEN '.M' ELSE '8250' END",
    "lesionsize": "CASE WHEN c_custkey % 3 = 0 THEN '.N' ELSE CAST(c_custkey % 60 AS VARCHAR(20)) END",
    "scr_res0": "CAST(c_nationkey % 6 AS VARCHAR(20))",
    "scr_days0": "CAST(c_custkey % 90 AS VARCHAR(20))",
    "scr_res1": "CASE WHEN c_custkey % 4 = 0 THEN '.N' ELSE CAST(c_nationkey % 4 AS VARCHAR(20)) END",
    "scr_days1": "CASE WHEN c_custkey % 8 = 0 THEN '.N' ELSE CAST(365 + c_custkey % 30 AS VARCHAR(20)) END",
    "loclup": "CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END",
    "locrmid": "CASE WHEN c_custkey % 3 = 0 THEN '1.0' ELSE '.N' END",
    "loccar": "CASE WHEN c_custkey % 5 = 0 THEN ' 1 ' ELSE '' END",
}


def participants(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as trial participants with coded columns."""
    return load(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"), "c_custkey", *[F.expr(e).alias(c) for c, e in CODED.items()])


PARTICIPANTS_SQL = "participants AS (SELECT CAST(c_custkey AS VARCHAR) AS pid, c_custkey, " + ", ".join(
    f"{e} AS {c}" for c, e in CODED.items()) + " FROM customer)"

CODE_COLUMNS = ["race", "de_stag", "can_scr", "scr_res0"]
REGION_COLUMNS = ["gender", "cigsmok", "scr_res1", "cancyr"]


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Nations and regions as the option lists of coded columns."""
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("t"), F.lit(CODE_COLUMNS[0]).alias("_f"))
    region = load(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("t"), F.lit(REGION_COLUMNS[0]).alias("_f"))
    one = lambda df: df.agg(F.sort_array(F.collect_list(F.struct(
        F.col("k").cast("string").alias("option_code"), F.concat(F.lit(" "), "t").alias("option_description")))).alias("values"))

    def named(df: DataFrame, columns: list[str]) -> DataFrame:
        names = F.array(*[F.struct(F.lit("nlst_prsn").alias("short_table_name"), F.lit(c).alias("column"),
                                   F.lit(f"{c} code: as coded on the form").alias("column_label")) for c in columns])
        return one(df).select(F.explode(names).alias("n"), "values").select("n.*", "values")

    return named(nation, CODE_COLUMNS).unionByName(named(region, REGION_COLUMNS))


DICTIONARY_SQL = f"""codes AS (SELECT 'nlst_prsn' AS short_table_name, c AS col, CAST(n_nationkey AS VARCHAR) AS code, n_name AS text
    FROM nation, (SELECT unnest({CODE_COLUMNS}) AS c)
  UNION ALL SELECT 'nlst_prsn', c, CAST(r_regionkey AS VARCHAR), r_name FROM region, (SELECT unnest({REGION_COLUMNS}) AS c))"""


def duck_missing(c: str) -> str:
    codes = ", ".join(f"'{m}'" for m in MISSING_CODES)
    return f"({c} IS NULL OR {duck_strip(c)} IN ({codes}))"


def duck_int(c: str) -> str:
    n = duck_number(duck_strip(c))
    return f"CASE WHEN NOT {duck_missing(c)} THEN CAST(trunc({n}) AS BIGINT) END"


# --------------------------------------------------------------- slice volumes

DEPTH = 12  # slices of a stand-in volume
SIDE = 16


def slices(spark: SparkSession, sf: str) -> DataFrame:
    """Four embeddings make a 16 x 16 slice, twelve slices a volume, three volumes a patient.

    HU is a whole-number function of the embedding, so later work is exact.
    A slice short of embeddings is filled with air.
    """
    air = F.array_repeat(F.lit(-1024), 64)
    hu = F.transform("embedding", lambda e: F.floor(e.cast("double") * 2000 - 500).cast("int"))
    parts = load(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("slice_uid"), (F.col("vec_id") % 4).alias("q"), hu.alias("px"))
    whole = parts.groupBy("slice_uid").agg(*[F.max(F.when(F.col("q") == q, F.col("px"))).alias(f"p{q}") for q in range(4)])
    made = whole.select("slice_uid", F.floor(F.col("slice_uid") / DEPTH).alias("volume_id"),
                        F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"),
                        F.concat(*[F.coalesce(f"p{q}", air) for q in range(4)]).alias("px"))
    # At most DEPTH slices per volume, so a plain window numbers them.
    w = W.partitionBy("volume_id")
    return made.withColumns({"z": F.row_number().over(w.orderBy("slice_uid")) - 1, "depth": F.count(F.lit(1)).over(w).cast("int")}).select(
        "volume_id", "z", "depth", "rows", "cols", "px", "slice_uid")


SLICES_SQL = """vox0 AS (SELECT s, q * 4 + i // 16 AS y, i % 16 AS x, coalesce(CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 2000 - 500) AS INT), -1024) AS hu
    FROM (SELECT DISTINCT vec_id // 4 AS s FROM embeddings), (SELECT unnest(range(4)) AS q), (SELECT unnest(range(64)) AS i)
    LEFT JOIN embeddings ON vec_id = s * 4 + q),
zs AS (SELECT s, s // 12 AS volume_id, row_number() OVER (PARTITION BY s // 12 ORDER BY s) - 1 AS z, count(*) OVER (PARTITION BY s // 12) AS depth
    FROM (SELECT DISTINCT s FROM vox0)),
vox AS (SELECT volume_id, z, depth, y, x, y * 16 + x AS p, hu FROM vox0 JOIN zs USING (s))"""


def chest(spark: SparkSession, sf: str) -> DataFrame:
    """The volumes inside a ring of tissue, so that air pockets do not reach the side walls."""
    ring = F.transform("px", lambda v, i: F.when(
        (i < SIDE) | (i >= SIDE * (SIDE - 1)) | (i % SIDE == 0) | (i % SIDE == SIDE - 1), 200).otherwise(v))
    return slices(spark, sf).withColumn("px", ring)


CHEST_SQL = f"""{SLICES_SQL},
chest AS (SELECT volume_id, z, depth, y, x, p, CASE WHEN y IN (0, 15) OR x IN (0, 15) THEN 200 ELSE hu END AS hu FROM vox)"""


def joined(c: str) -> F.Column:
    """A pixel array as text, so that both engines compare the same value."""
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def duck_joined(value: str, order: str = "p") -> str:
    return f"array_to_string(list({value} ORDER BY {order}), ',')"

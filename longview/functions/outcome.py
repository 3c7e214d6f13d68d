"""Label text, label sources and coded clinical values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number, strip

POSITIVE, NEGATIVE, UNKNOWN = 1, 0, -1

# Label sources, most trusted first.
SOURCE_PRIORITY = ["cdas", "idc", "nlstseg", "sybil", "manual", "none"]
# Label texts.
POSITIVE_TEXT = ["1", "yes", "y", "true", "positive", "cancer"]
NEGATIVE_TEXT = ["0", "no", "n", "false", "negative"]
UNKNOWN_TEXT = ["", "na", "nan", "null", "unknown", "."]
# Markers the clinical extract uses in place of a value.
MISSING_CODES = ["", ".", ".M", ".N", ".F", ".A", "nan", "None"]
# Units and short labels of clinical columns.
COLUMN_UNITS = {"age": "years", "lesionsize": "mm"}
LABEL_OVERRIDES = {
    "age": "Age at randomisation",
    "de_type": "Histology",
    "de_stag": "Stage (AJCC 6)",
    "de_stag_7thed": "Stage (AJCC 7)",
    "de_grade": "Grade",
    "lesionsize": "Lesion size",
    "cigsmok": "Smoking at T0",
}
# ICD-O-3 morphology codes of the trial.
HISTOLOGY = {
    "8000": "Malignant neoplasm, NOS",
    "8001": "Malignant tumour cells",
    "8010": "Carcinoma, NOS",
    "8012": "Large cell carcinoma",
    "8013": "Large cell neuroendocrine carcinoma",
    "8021": "Carcinoma, anaplastic",
    "8022": "Pleomorphic carcinoma",
    "8032": "Spindle cell carcinoma",
    "8033": "Pseudosarcomatous carcinoma",
    "8041": "Small cell carcinoma",
    "8042": "Oat cell carcinoma",
    "8044": "Small cell carcinoma, intermediate cell",
    "8045": "Combined small cell carcinoma",
    "8046": "Non-small cell carcinoma",
    "8050": "Papillary carcinoma",
    "8052": "Papillary squamous cell carcinoma",
    "8070": "Squamous cell carcinoma",
    "8071": "Squamous cell carcinoma, keratinising",
    "8072": "Squamous cell carcinoma, large cell non-keratinising",
    "8075": "Squamous cell carcinoma, adenoid",
    "8083": "Basaloid squamous cell carcinoma",
    "8084": "Squamous cell carcinoma, clear cell type",
    "8140": "Adenocarcinoma, NOS",
    "8240": "Carcinoid tumour",
    "8246": "Neuroendocrine carcinoma",
    "8249": "Atypical carcinoid tumour",
    "8250": "Bronchioloalveolar adenocarcinoma",
    "8252": "Bronchioloalveolar carcinoma, non-mucinous",
    "8253": "Bronchioloalveolar carcinoma, mucinous",
    "8254": "Bronchioloalveolar carcinoma, mixed",
    "8255": "Adenocarcinoma with mixed subtypes",
    "8260": "Papillary adenocarcinoma",
    "8310": "Clear cell adenocarcinoma",
    "8323": "Mixed cell adenocarcinoma",
    "8430": "Mucoepidermoid carcinoma",
    "8480": "Mucinous adenocarcinoma",
    "8481": "Mucin-producing adenocarcinoma",
    "8490": "Signet ring cell carcinoma",
    "8550": "Acinar cell carcinoma",
    "8560": "Adenosquamous carcinoma",
    "8570": "Adenocarcinoma with squamous metaplasia",
    "8980": "Carcinosarcoma",
}
# Lesion location flags, in report order.
LESION_LOCATIONS = {
    "loclup": "left upper lobe",
    "locllow": "left lower lobe",
    "loclhil": "left hilum",
    "locrup": "right upper lobe",
    "locrmid": "right middle lobe",
    "locrlow": "right lower lobe",
    "locrhil": "right hilum",
    "locmed": "mediastinum",
    "loclmsb": "left main bronchus",
    "locrmsb": "right main bronchus",
    "loccar": "carina",
    "loclin": "lingula",
    "locoth": "other",
    "locunk": "unknown",
}


def coerce_label(value: Column, year_coded: bool = False) -> Column:
    """Label text to 1 / 0 / -1; unknown never turns into a negative.

    Any number above zero confirms a diagnosis. Zero written as a float is a
    negative too, unless ``year_coded`` says numbers are study years, where
    every year from 0 confirms one (only the bare text ``0`` stays negative).
    """
    t = F.lower(strip(value.cast("string")))
    n = number(t)
    hit = n >= 0 if year_coded else n > 0
    out = (
        F.when(t.isin(POSITIVE_TEXT), POSITIVE)
        .when(t.isin(NEGATIVE_TEXT), NEGATIVE)
        .when(t.isin(UNKNOWN_TEXT), UNKNOWN)
    )
    if not year_coded:
        out = out.when(n == 0, NEGATIVE)
    return out.when(hit, POSITIVE).otherwise(UNKNOWN)


def infer_source(file_stem: Column) -> Column:
    """The first known source named in a file stem, else ``manual``."""
    name = F.lower(file_stem)
    return F.coalesce(*[F.when(name.contains(s), F.lit(s)) for s in SOURCE_PRIORITY], F.lit("manual"))


def source_rank(source: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCE_PRIORITY]), source)
    return F.when(place > 0, place - 1).otherwise(len(SOURCE_PRIORITY)).cast("int")


def is_missing(value: Column) -> Column:
    t = strip(value.cast("string"))
    return value.isNull() | t.isin(MISSING_CODES) | (t == "NaN")


def as_int(value: Column) -> Column:
    """Coded number to a whole number, truncated; null when missing or not finite."""
    n = number(strip(value.cast("string")))
    return F.when(~is_missing(value) & (F.abs(n) < float("inf")), n.try_cast("bigint"))


def histology(code: Column) -> Column:
    """``name (ICD-O-3 code)`` for the trial's codes, else null."""
    pairs = [F.lit(x) for kv in HISTOLOGY.items() for x in kv]
    name = F.element_at(F.create_map(*pairs), strip(code))
    return F.when(name.isNotNull(), F.concat(name, F.lit(" (ICD-O-3 "), strip(code), F.lit(")")))


def short_label(label: Column) -> Column:
    """The part of a dictionary label before the colon; null when empty."""
    head = strip(F.get(F.split(strip(label), ":"), F.lit(0)))
    return F.when(F.length(strip(label)) > 0, head)


def column_label(column: Column, dictionary_label: Column) -> Column:
    pairs = [F.lit(x) for kv in LABEL_OVERRIDES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), short_label(dictionary_label), column)


def with_units(column: Column, value: Column) -> Column:
    """Append a column's units unless the value already carries them."""
    pairs = [F.lit(x) for kv in COLUMN_UNITS.items() for x in kv]
    unit = F.element_at(F.create_map(*pairs), column)
    return F.when(unit.isNotNull() & ~value.contains(unit), F.concat(value, F.lit(" "), unit)).otherwise(value)


def lesion_locations(flags: dict[str, Column]) -> Column:
    """Names of the set location flags, in the fixed order."""
    names = [F.when(strip(flags[c].cast("string")).isin("1", "1.0", "True", "true"), F.lit(n))
             for c, n in LESION_LOCATIONS.items() if c in flags]
    return F.array_compact(F.array(*names))


def years_to_diagnosis(days: Column) -> Column:
    return F.round(days / F.lit(365.25), 2)

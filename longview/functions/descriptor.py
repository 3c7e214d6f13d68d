"""Series descriptions: parsing, rounds and kernel styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number, strip

# Fixed values of the imaging archive.
MISSING_TEXT = ["", "na", "null", "none", "nan"]
AXIAL_KIND = "OPA"
SMOOTH_KERNELS = [
    "STANDARD", "SOFT", "A", "B",
    "B10F", "B20F", "B30F", "B31F",
    "FC01", "FC02", "FC03", "FC10",
]
SHARP_KERNELS = [
    "LUNG", "BONE", "DETAIL", "EDGE", "C", "D", "E", "YA",
    "B40F", "B45F", "B50F", "B60F", "B70F", "B80F",
    "FC30", "FC50", "FC51", "FC52", "FC53",
]
# Description fields by position.
TEXT_FIELDS = {"manufacturer": 2, "model": 3, "kernel": 4}
NUMBER_FIELDS = {"fov_mm": 5, "slice_mm": 6, "kvp": 7, "ma": 8}


def description_fields(description: Column) -> Column:
    """The trimmed fields of a description, missing markers still in place.

    White space around the commas is removed in one pass over the text. Put
    this in a column of its own, so that it is computed once.
    """
    tight = F.regexp_replace(strip(F.coalesce(description, F.lit(""))), r"(?U)[\s\x1c-\x1f]*,[\s\x1c-\x1f]*", ",")
    return F.split(tight, ",")


def field(fields: Column, index: int) -> Column:
    """One field; null when absent or a missing marker."""
    value = F.get(fields, F.lit(index))
    return F.when(~F.lower(value).isin(MISSING_TEXT), value)


def text_field(fields: Column, name: str) -> Column:
    return field(fields, TEXT_FIELDS[name])


def number_field(fields: Column, name: str) -> Column:
    return number(field(fields, NUMBER_FIELDS[name]))


def study_year(fields: Column) -> Column:
    year = number(field(fields, 0))
    return F.when(year.isin(0.0, 1.0, 2.0), year.cast("int"))


def round_label(year: Column) -> Column:
    return F.when(year.isin(0, 1, 2), F.concat(F.lit("T"), year.cast("string")))


def series_kind(fields: Column) -> Column:
    return F.upper(field(fields, 1))


def describes_axial(description: Column) -> Column:
    """The axial test on the raw description, cheap enough to run before parsing."""
    kind = F.upper(strip(F.get(F.split(description, ",", 3), F.lit(1))))
    return is_axial(kind)


def is_axial(kind: Column) -> Column:
    return F.coalesce(kind == AXIAL_KIND, F.lit(False))


def kernel_style(kernel: Column) -> Column:
    key = F.upper(strip(kernel))
    return F.when(key.isin(SMOOTH_KERNELS), "smooth").when(key.isin(SHARP_KERNELS), "sharp").otherwise("other")


def kernel_rank(style: Column) -> Column:
    return F.when(style == "smooth", 0).when(style == "other", 1).when(style == "sharp", 2).otherwise(3)


def parse_description(description: Column, fields: Column) -> Column:
    """Every field of a description as one struct."""
    parsed = [strip(F.coalesce(description, F.lit(""))).alias("raw"), study_year(fields).alias("study_year"),
              series_kind(fields).alias("kind")]
    parsed += [text_field(fields, n).alias(n) for n in TEXT_FIELDS]
    parsed += [number_field(fields, n).alias(n) for n in NUMBER_FIELDS]
    return F.struct(*parsed)


def round_key(label: Column, study_date: Column) -> Column:
    """The round, or ``D<date>`` when the description does not name one."""
    return F.coalesce(label, F.concat(F.lit("D"), F.coalesce(study_date.cast("string"), F.lit("unknown"))))


def dashed_date(yyyymmdd: Column) -> Column:
    """``YYYYMMDD`` to ``YYYY-MM-DD``; any other length is passed through."""
    d = F.coalesce(yyyymmdd, F.lit(""))
    return F.when(F.length(d) == 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(d)


def series_slug(patient: Column, study_date: Column, kernel: Column, series_uid: Column) -> Column:
    """A readable series id: patient, date, kernel and the last six uid characters."""
    def known(c: Column, default: str) -> Column:
        return F.when(F.length(c) > 0, c).otherwise(F.lit(default))

    tail = F.when(F.length(series_uid) > 6, F.right(series_uid, F.lit(6))).otherwise(series_uid)
    return F.concat_ws("_", F.coalesce(patient, F.lit("NA")), known(study_date, "NA"), known(kernel, "NA"), known(tail, "000000"))

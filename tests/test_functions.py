"""Scalar functions against hand-computed values."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from longview.functions import descriptor as D
from longview.functions import hashing as H
from longview.functions import narrative as N
from longview.functions import outcome as O
from longview.functions import risk as R
from longview.functions import voxel as V
from longview.functions.text import half_even, number, strip


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_description_fields(spark):
    rows = [("0,OPA,GE,LSPLUS,STANDARD,360,2.5,120,80,0.1,1.5",), (None,), ("",), ("1,opl",), ("\t2 ,OPA, na ,null,B50f ,x,1.5d,0x1p3,1_0",),
            ("3,OPA",), ("0.0,OPA",)]
    df = spark.createDataFrame(rows, "d string").withColumn("f", D.description_fields(F.col("d")))
    got = df.select(D.parse_description(F.col("d"), F.col("f")).alias("p")).select("p.*").collect()
    assert tuple(got[0])[1:] == (0, "OPA", "GE", "LSPLUS", "STANDARD", 360.0, 2.5, 120.0, 80.0)
    assert got[1]["raw"] == "" and got[1]["study_year"] is None and got[2]["kind"] is None
    assert (got[3]["study_year"], got[3]["kind"], got[3]["kernel"]) == (1, "OPL", None)
    assert tuple(got[4])[1:] == (2, "OPA", None, None, "B50f", None, None, None, 10.0)
    assert got[5]["study_year"] is None and got[6]["study_year"] == 0


def test_kernel_styles_and_rounds(spark):
    got = one(spark, [("standard ",), ("B50F",), ("zz",), (None,), ("",)], "k string", D.kernel_style(F.col("k")))
    assert [g[0] for g in got] == ["smooth", "sharp", "other", "other", "other"]
    got = one(spark, [("T1", "20000101"), (None, "20000101"), (None, None)], "r string, d string", D.round_key(F.col("r"), F.col("d")))
    assert [g[0] for g in got] == ["T1", "D20000101", "Dunknown"]


def test_slug_and_date(spark):
    got = one(spark, [("1", "20000102", "LUNG", "1.2.345678"), (None, None, None, None), ("1", "", "", "12")], "p string, d string, k string, u string",
              D.series_slug(*[F.col(c) for c in "pdku"]), D.dashed_date(F.col("d")))
    assert got == [("1_20000102_LUNG_345678", "2000-01-02"), ("NA_NA_NA_000000", ""), ("1_NA_NA_12", "")]


def test_number_is_strict(spark):
    got = one(spark, [("1.5",), ("1.5d",), ("0x1p3",), (".5",), ("5.",), ("1e2",), ("1_0",), ("",), ("-inf",), ("+3",)], "t string", number(F.col("t")))
    assert [g[0] for g in got] == [1.5, None, None, 0.5, 5.0, 100.0, 10.0, None, float("-inf"), 3.0]


def test_strip_takes_every_white_space(spark):
    assert one(spark, [("\t a b \n",)], "t string", strip(F.col("t"))) == [("a b",)]


def test_half_even_is_exact(spark):
    random.seed(3)
    xs = [0.5, 1.5, 2.5, -0.5, 6.5, 0.35, 0.45, 2.675, 0.0135375, 1e-9, 123456.785] + [random.randint(-4000, 4000) / 40 for _ in range(500)]
    for d in (0, 1, 2, 6):
        for x, r in one(spark, [(x,) for x in xs], "x double", F.col("x"), half_even(F.col("x"), d)):
            assert r == round(x, d), (x, d)


def test_split_value_matches_the_digest(spark):
    ids = [str(100000 + i) for i in range(500)]
    for pid, v in one(spark, [(i,) for i in ids], "p string", F.col("p"), H.split_value(F.col("p"))):
        assert v == (int(hashlib.sha256(f"nlst-v1:{pid}".encode()).hexdigest(), 16) % 10_000) / 10_000


def test_frozen_splits(spark):
    frozen = {"100002": (0.3404, "train"), "100004": (0.3098, "train"), "115345": (0.2727, "train"), "123342": (0.7072, "val"), "200511": (0.4313, "train")}
    got = one(spark, [(k,) for k in frozen], "p string", F.col("p"), H.split_value(F.col("p")), H.assign_split(F.col("p")))
    assert {p: (v, s) for p, v, s in got} == frozen


@pytest.mark.parametrize("bad", [(0.5, 0.5), (0.5, 0.3, 0.3), (1.2, -0.1, -0.1)])
def test_bad_fractions(bad):
    with pytest.raises(ValueError):
        H.check_fractions(bad)


def test_coerce_label(spark):
    texts = ["1", "yes", " Cancer ", "0", "no", "0.0", ".", "", None, "2", "-1", "abc"]
    got = one(spark, [(t,) for t in texts], "t string", O.coerce_label(F.col("t")), O.coerce_label(F.col("t"), True))
    assert [g[0] for g in got] == [1, 1, 1, 0, 0, 0, -1, -1, -1, 1, -1, -1]
    assert [g[1] for g in got] == [1, 1, 1, 0, 0, 1, -1, -1, -1, 1, -1, -1]
    got = one(spark, [(0.0,), (1.0,), (float("nan"),), (None,)], "t double", O.coerce_label(F.col("t")))
    assert [g[0] for g in got] == [0, 1, -1, -1]


def test_clinical_values(spark):
    got = one(spark, [("12.7",), (".N",), (" 5 ",), ("x",), (None,), ("-3.9",)], "v string", O.as_int(F.col("v")), O.is_missing(F.col("v")))
    assert got == [(12, False), (None, True), (5, False), (None, False), (None, True), (-3, False)]
    got = one(spark, [("8140",), ("9999",), (None,)], "c string", O.histology(F.col("c")))
    assert [g[0] for g in got] == ["Adenocarcinoma, NOS (ICD-O-3 8140)", None, None]
    got = one(spark, [("cdas_2020", "idc"), ("boxes_Sybil", "weird"), ("hospital", None)], "a string, b string", O.infer_source(F.col("a")), O.source_rank(F.col("b")))
    assert got == [("cdas", 1), ("sybil", 6), ("manual", 6)]


def test_risk_curves(spark):
    curves = [[.01, .02, .04, .06, .09, .12], [.05] * 6, [.1, .2, 1.4, .5, .6, .7], [-.1, .2, .3, .4, .5, .6], [.10, .09, .2, .3, .4, .5], [.1, .2, .3]]
    got = one(spark, [(c,) for c in curves], "c array<double>", R.curve_violation(F.col("c")))
    assert [g[0] for g in got] == [None, None, "range", "range", "decrease", "length"]
    got = one(spark, [([.05, .04, .20, .03, .25, .10],), ([-1.0, .5, 2.0, 0.0, 0.0, 0.0],)], "c array<double>", R.monotone(F.col("c")))
    assert got[0][0] == [.05, .05, .20, .20, .25, .25] and got[1][0] == [0.0, .5, 1.0, 1.0, 1.0, 1.0]
    with pytest.raises(Exception, match="invalid risk curve: decrease"):
        one(spark, [(curves[4],)], "c array<double>", R.require_valid(F.col("c")))


def test_hu_and_windows(spark):
    got = one(spark, [([0, 100, 30000],)], "p array<int>", V.rescale_hu(F.col("p"), F.lit(0.0), F.lit(None).cast("double")),
              V.rescale_hu(F.col("p"), F.lit(2.5), F.lit(-1024.0)), V.shift16(F.col("p")), V.clip_hu(F.col("p")))
    assert got[0] == ([0, 100, 30000], [-1024, -774, 32767], [1024, 1124, 31024], [0, 100, 400])
    got = one(spark, [([-1350, -600, 150, 999],)], "p array<int>", V.window8(F.col("p"), -600.0, 1500.0))
    assert got[0][0] == [0, 128, 255, 255]
    assert V.window_of(["soft"]) == (40.0, 400.0) and V.window_of(["1", "2"]) == (1.0, 2.0)
    with pytest.raises(ValueError):
        V.window_of(["brain"])


def test_side_and_diameter(spark):
    got = one(spark, [(10, 20, 100), (80, 90, 100)], "a int, b int, w int", V.side(F.col("a"), F.col("b"), F.col("w")))
    assert [g[0] for g in got] == ["right", "left"]
    got = one(spark, [(V.sphere_volume(8.0),)], "v double", V.equivalent_diameter(F.col("v")))
    assert got[0][0] == pytest.approx(8.0)


def test_summary_rules(spark):
    pair = "struct<from_round:string,to_round:string,registration_failed:boolean,deformable:boolean,n_regions:int,top:struct<kind:string,side:string,delta_mm:double,baseline_hu:double,followup_hu:double,slice:int>>"
    top = ("new", "left", 6.5, -850.2, -20.7, 41)
    rows = [([("T0", "T1", False, True, 1, top)],), ([("T0", "T1", True, False, 3, top)],), ([("T1", "T2", False, False, 0, None)],), (None,)]
    got = one(spark, rows, f"p array<{pair}>", N.change_sentence(F.col("p")), N.registration_caveat(F.col("p")))
    assert "1 candidate region met the thresholds. The largest, about 6 mm across in the left lung, appeared where none was visible before (density -850 to -21 HU, slice 41)" in got[0][0]
    assert got[0][1] == "" and "could not be aligned" in got[1][0] and "candidate" not in got[1][0] and got[1][1] == ""
    assert got[2] == ("Comparing the second annual follow-up with the first annual follow-up, no region met the change thresholds.", N.DEFORMABLE_CAVEAT)
    assert got[3] == ("", "")
    text = one(spark, [(None,)], "x double", N.compose(N.risk_sentence(F.lit(False), F.col("x"), F.lit(None), F.lit(True)), F.lit(""), F.lit("")))
    assert text[0][0] == f"{N.NO_MODEL} {N.DISCLAIMER}"

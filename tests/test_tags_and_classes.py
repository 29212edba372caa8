import pytest
from pyspark.sql import functions as F

from mapweave.functions import classify, tags
from mapweave.functions.columns import rgba


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_leading_numbers(spark):
    texts = ["12 m", "12.5m", " 9", "tall", "3;4", "2.5", "50 mph", "-1", ".5", "99999999999", "", None]
    assert column(spark, texts, tags.leading_int) == [12, 12, 9, None, 3, 2, 50, -1, None, None, None, None]
    assert column(spark, texts, tags.leading_float) == [12, 12.5, 9, None, 3, 2.5, 50, -1, 0.5, 99999999999, None, None]
    assert column(spark, ["1e39", "1e3", "+2."], tags.leading_float) == [None, 1000.0, 2.0]
    assert column(spark, ["0x1A", " -0xff m", "0x", "0"], tags.leading_float) == [26.0, -255.0, 0.0, 0.0]


def test_heights_cut_at_first_blank(spark):
    height = lambda v: classify.building_height(v, F.lit("4"), F.lit("house"), 3.0, 10.0)
    assert column(spark, ["12 m", "12.5m", " 9", "tall", "30M", None], height) == [12, 12.5, 12, 12, 30, 12]
    by_type = lambda v: classify.building_height(F.lit(None).cast("string"), F.lit("n/a"), v, 3.0, 10.0)
    words = ["garage", "bungalow", "dormitory", "office", "warehouse", "cathedral", "hospital", "school", "yes", None]
    assert column(spark, words, by_type) == [3, 8, 15, 20, 12, 25, 18, 12, 10, 10]


def test_levels_round_toward_zero(spark):
    levels = lambda v: classify.building_levels(v, F.lit(11.0), 3.0)
    assert column(spark, ["4", "2.5", "n/a", None], levels) == [4, 2, 3, 3]


def test_road_width_and_lanes(spark):
    width = lambda v: classify.road_width(v, F.lit("3;4"), F.lit("Path"))
    assert column(spark, ["7.5", "12 m", " 9", "wide", None], width) == [7.5, 12, 9, 10.5, 10.5]
    bare = lambda v: classify.road_width(F.lit(None).cast("string"), F.lit("x"), v)
    assert column(spark, ["Motorway", "Trunk", "Path", "Unknown"], bare) == [14, 10.5, 1.5, 6]
    lanes = lambda v: classify.road_lanes(F.lit(None).cast("string"), v)
    assert column(spark, ["Motorway", "Trunk", "Primary", "Service", "Unknown"], lanes) == [4, 3, 2, 1, 2]


@pytest.mark.parametrize(
    "shape, other, expected",
    [(None, "dome", "Dome"), ("gabled", "dome", "Gabled"), (None, None, "Flat"), ("mansard", None, "Unknown"), ("lean_to", None, "Skillion")],
)
def test_roof_falls_back_to_second_key(spark, shape, other, expected):
    row = spark.createDataFrame([(shape, other)], "a string, b string").select(classify.roof_class(F.col("a"), F.col("b")))
    assert row.first()[0] == expected


def test_unknown_area_values_fall_through(spark):
    cases = [
        (("peak", "riverbank", None, None, None), "Water"), (("water", None, "park", None, None), "Water"),
        ((None, "river", "pitch", "vineyard", None), "Farmland"), ((None, None, None, "quarry", "parking"), "Parking"),
        (("peak", "river", "pitch", "quarry", "bench"), "Unknown"),
    ]
    rows = spark.createDataFrame([c[0] for c in cases], "a string, b string, c string, d string, e string")
    got = rows.select(classify.area_class(*[F.col(k) for k in "abcde"])).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]


def test_flags(spark):
    assert column(spark, ["yes", "1", "-1", "true", None], tags.is_oneway) == [True, True, False, False, False]
    assert column(spark, ["yes", "no", "viaduct", None], tags.is_marked) == [True, False, True, False]


def test_colours(spark):
    fallback = (0.0, 0.25, 0.5, 1.0)
    got = column(spark, ["ReD", "#abc", "A1B2C3", "zzz", "", None, "#12345g", "#1234567"], lambda v: tags.parse_colour(v, rgba(fallback)))
    assert tuple(got[0]) == (0.8, 0.2, 0.2, 1.0)
    assert tuple(got[1]) == pytest.approx((170 / 255, 187 / 255, 204 / 255, 1))
    assert tuple(got[2]) == pytest.approx((161 / 255, 178 / 255, 195 / 255, 1))
    assert all(tuple(c) == fallback for c in got[3:])

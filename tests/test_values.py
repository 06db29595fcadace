"""Missing values, 32-bit arithmetic, rounding, classes, colours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import geo, palette, values
from terracell.schema import BBox


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


NAN = float("nan")


def test_nan_is_missing_and_exceeds_nothing(spark):
    v = values.missing_if_nan(F.lit(NAN).cast("float"))
    assert one(spark, v) is None
    assert one(spark, values.exceeds(v, 1)) is None
    assert one(spark, values.missing_to_sentinel(v)) == -9999.0


def test_value_equal_to_trigger_does_not_exceed(spark):
    v = F.lit(0.1).cast("float")
    assert one(spark, values.exceeds(v, 0.1)) is False
    assert one(spark, v > F.lit(0.1)) is True  # what a 64-bit literal would do


@pytest.mark.parametrize("raw", [250.0, 273.15, 299.987, 310.123])
def test_kelvin_stays_32_bit(spark, raw):
    got = one(spark, values.kelvin_to_celsius(F.lit(raw), F.lit("2m_Temperature")))
    assert np.float32(got) == np.float32(raw) - np.float32(273.15)
    assert one(spark, values.kelvin_to_celsius(F.lit(raw), F.lit("precip"))) == np.float32(raw)


def test_ndvi(spark):
    f = lambda a, b: one(spark, values.ndvi(F.lit(a), F.lit(b)))
    assert f(0.0, 0.0) is None
    assert f(None, 1.0) is None
    assert f(NAN, 1.0) is None
    assert f(3.0, 1.0) == 0.5
    assert f(3.0, -1.0) == 1.0  # 2.0 before clipping
    assert f(-1.0, 3.0) == -1.0


def test_scale_and_mask_bounds(spark):
    f = lambda a: one(spark, values.scale_and_mask(F.lit(a)))
    assert f(10000) == 1.0 and f(-10000) == -1.0
    assert f(10002) is None and f(-10002) is None and f(None) is None
    assert np.float32(f(1234)) == np.float32(1234) * np.float32(0.0001)


def test_rounding_is_half_even(spark):
    assert one(spark, values.round2(F.lit(0.125).cast("float"))) == 0.12
    assert one(spark, values.round2(F.lit(0.375).cast("float"))) == 0.38
    for v in (2.675, 1.005, 12.345):
        v = float(np.float32(v))
        assert one(spark, values.round2(F.lit(v))) == round(v, 2)


def test_longitudes(spark):
    f = lambda x: one(spark, geo.normalize_lon(F.lit(float(x))))
    assert [f(x) for x in (0, 179, 180, 270, 360, -180, -75)] == [0, 179, -180, -90, 0, -180, -75]


def test_pixel_index_truncates_toward_zero(spark):
    x, y = geo.lonlat_to_pixel(F.lit(6.51), F.lit(-75.01), F.lit(100), F.lit(100), BBox(-75, -35, -33.5, 6.5))
    assert (one(spark, x), one(spark, y)) == (0, 0)


BOUNDS = [0.0, 1.0, 10.0]


@pytest.mark.parametrize("v,k", [(-0.1, -1), (0.0, 0), (0.9, 0), (1.0, 1), (9.9, 1), (10.0, 2), (99, 2), (None, None)])
def test_classes_are_left_closed(spark, v, k):
    v = F.lit(v).cast("double")
    assert one(spark, palette.classify(v, BOUNDS)) == k
    assert one(spark, palette.classify(v, F.array(*[F.lit(b) for b in BOUNDS]))) == k


def test_class_colors(spark):
    f = lambda k, n, colors: one(spark, palette.class_color(F.lit(k).cast("int"), n, colors))
    three = ["#000000", "#111111", "#222222"]
    assert f(None, 4, three) == palette.TRANSPARENT
    assert [f(k, 4, three) for k in (-1, 0, 1, 2, 3)] == [three[0], *three, three[2]]
    # Spare colours are spread: two classes out of three colours take the ends.
    assert [f(k, 3, three) for k in (0, 1)] == [three[0], three[2]]
    with pytest.raises(ValueError):
        palette.class_color(F.lit(1), 5, three)


def test_ramp_mixes_between_stops(spark):
    f = lambda v, s="precipitation_4": one(spark, palette.color_ramp(F.lit(v).cast("double"), s)).asDict()
    assert f(None) == {"color": palette.TRANSPARENT, "opacity": 0.0}
    assert f(-5) == {"color": "#0000FF", "opacity": 0.0}
    assert f(5) == {"color": "#008080", "opacity": 0.5}
    assert f(10) == {"color": "#00FF00", "opacity": 1.0}
    assert f(30) == {"color": "#80FF00", "opacity": 1.0}
    assert f(1000)["color"] == "#FF0000"


def test_palette_text(spark):
    got = one(spark, palette.parse_bounds(F.lit("1, 2.5,x")))
    assert got == [0.0, 1.0, 2.5, None]
    assert one(spark, palette.parse_colors(F.lit("FFFFFF, #00ff00"))) == [
        "#00000000", "#FFFFFF", "#00ff00"]
    default = one(spark, palette.parse_colors(F.lit(None).cast("string")))
    assert len(default) == 13
    bounds = palette.parse_bounds(F.lit(palette.DEFAULT_BOUNDS))
    assert one(spark, palette.palette_status(bounds, palette.parse_colors(F.lit("")))) == "ok"


def test_haversine(spark):
    km = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert math.isclose(km, 6371 * math.pi / 2, rel_tol=1e-12)


def test_box_orders():
    want = BBox(-75, -35, -33.5, 6.5)
    assert BBox.from_swne((-35, -75, 6.5, -33.5)) == want
    assert BBox.from_nwse((6.5, -75, -35, -33.5)) == want
    for bad in ((0, 1, 1, 1), (1, 0, 1, 1), (2, 0, 1, 1)):
        with pytest.raises(ValueError):
            BBox(*bad)

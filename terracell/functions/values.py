"""Cell values: missing data, units, masks, rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terracell.functions.geo import _col
from terracell.schema import NO_VALUE

# Unit offset and the scale of packed vegetation values.
KELVIN_OFFSET = 273.15
PACKED_SCALE = 0.0001


def float_lit(x) -> Column:
    """Cells are 32-bit: numbers that meet them must be 32-bit as well."""
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def missing_if_nan(value) -> Column:
    """NaN to NULL.  Spark calls NaN larger than any number, so it must not stay."""
    value = _col(value)
    return F.when(~F.isnan(value), value)


def cast_value(value) -> Column:
    return _col(value).cast("float")


def kelvin_to_celsius(value, name) -> Column:
    """Subtracts the offset where the variable name says temperature."""
    value, name = cast_value(value), F.lower(_col(name))
    is_temperature = name.contains("temperature") | name.contains("t2m")
    return F.when(is_temperature, value - float_lit(KELVIN_OFFSET)).otherwise(value)


def exceeds(value, trigger) -> Column:
    """Strictly above the trigger; a missing value never is."""
    return _col(value) > float_lit(trigger)


def ndvi(nir, red) -> Column:
    """(nir - red) / (nir + red), missing at a zero sum, clipped to [-1, 1]."""
    nir, red = cast_value(nir), cast_value(red)
    total = nir + red
    ratio = F.when(total != 0, (nir - red) / total).cast("float")
    low, high = float_lit(-1), float_lit(1)
    return (
        F.when(ratio.isNull() | F.isnan(ratio), F.lit(None).cast("float"))
        .when(ratio < low, low)
        .when(ratio > high, high)
        .otherwise(ratio)
    )


def scale_and_mask(raw, scale: float = PACKED_SCALE, low: float = -1.0, high: float = 1.0) -> Column:
    """Packed integers to values; outside [low, high] is missing."""
    scaled = cast_value(raw) * float_lit(scale)
    return F.when(scaled.between(float_lit(low), float_lit(high)), scaled)


def round2(value) -> Column:
    """Half-even on the exact double of the 32-bit value."""
    return F.bround(_col(value).cast("double"), 2)


def round5(value) -> Column:
    return F.bround(_col(value).cast("double"), 5)


def missing_to_sentinel(value, sentinel: float = NO_VALUE) -> Column:
    return F.coalesce(_col(value).cast("double"), F.lit(float(sentinel)))

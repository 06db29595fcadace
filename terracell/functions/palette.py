"""Class breaks and colour ramps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terracell.functions.geo import _col

# Default class breaks and colours of an accumulation map.
DEFAULT_BOUNDS = "1,10,20,30,40,60,80,100,150,200,300,400,600"
DEFAULT_COLORS = (
    "#FFFFFF,#E8C2AA,#FF11FF,#FF79FF,#A37AFF,#0036D0,"
    "#114FFF,#20E2FC,#D5D5D5,#8CE89B,#BEFFBF,#E1FFE1"
)
TRANSPARENT = "#00000000"
# Fixed values: (quantity, colour, label, opacity) stops of the map styles.
STYLES = {
    "precipitation_4": [
        (0, "#0000FF", "No Data", 0),
        (10, "#00FF00", "Low", 1),
        (50, "#FFFF00", "Medium", 1),
        (100, "#FF0000", "High", 1),
    ],
    "precipitation_7": [
        (0, "#0000FF", "No Data", 0),
        (10, "#9ECAE1", "Very Low", 1),
        (50, "#6BAED6", "Low", 1),
        (100, "#4292C6", "Moderate", 1),
        (150, "#2171B5", "High", 1),
        (200, "#08306B", "Very High", 1),
        (300, "#FF0000", "Extreme", 1),
    ],
    "precipitation": [
        (0, "#FFFFFF", "0", 0),
        (1, "#50D0D0", "1", 1),
        (2.5, "#00FFFF", "2.5", 1),
        (5, "#00E080", "5", 1),
        (7.5, "#00C000", "7.5", 1),
        (10, "#CCE000", "10", 1),
        (15, "#FFFF00", "15", 1),
        (20, "#FFA000", "20", 1),
        (30, "#FF0000", "30", 1),
        (40, "#FF2080", "40", 1),
        (50, "#F041FF", "50", 1),
        (70, "#8020FF", "70", 1),
        (100, "#4040FF", "100", 1),
        (150, "#202080", "150", 1),
        (200, "#202020", "200", 1),
        (250, "#808080", "250", 1),
        (300, "#E0E0E0", "300", 1),
        (400, "#EED4BC", "400", 1),
        (500, "#DAA675", "500", 1),
        (600, "#A06C3C", "600", 1),
        (750, "#663300", "750", 1),
    ],
    "temperature": [
        (-10, "#08006B", "-10°C", 1),
        (0, "#1548AD", "0°C", 1),
        (5, "#4393C3", "5°C", 1),
        (10, "#7FB8D4", "10°C", 1),
        (15, "#ABD9E9", "15°C", 1),
        (20, "#D1EEF7", "20°C", 1),
        (25, "#FFFFBF", "25°C", 1),
        (30, "#FEE090", "30°C", 1),
        (35, "#FDAE61", "35°C", 1),
        (40, "#F46D43", "40°C", 1),
        (45, "#D73027", "45°C", 1),
        (50, "#A50026", "50°C", 1),
        (55, "#8B0000", "55°C", 1),
        (60, "#67001F", "60°C", 1),
    ],
}


def parse_bounds(text) -> Column:
    """``"1,10,20"`` to ``[0, 1, 10, 20]``; NULL items where a number is bad."""
    numbers = F.transform(F.split(_col(text), ","), lambda x: F.trim(x).try_cast("double"))
    return F.concat(F.array(F.lit(0.0)), numbers)


def parse_colors(text) -> Column:
    """Comma list to ``#``-colours, behind a transparent one for values under the
    first bound.  NULL or empty text means the default colours."""
    text = F.coalesce(F.nullif(_col(text), F.lit("")), F.lit(DEFAULT_COLORS))
    colors = F.transform(
        F.split(text, ","),
        lambda x: F.when(F.trim(x).startswith("#"), F.trim(x)).otherwise(
            F.concat(F.lit("#"), F.trim(x))
        ),
    )
    return F.concat(F.array(F.lit(TRANSPARENT)), colors)


def palette_status(bounds, colors) -> Column:
    """``bad_bounds``, ``too_few_colors``, ``bad_color`` or ``ok``."""
    bounds, colors = _col(bounds), _col(colors)
    named = F.slice(colors, F.lit(2), F.size(colors))
    bad = F.exists(named, lambda c: ~c.rlike("^#[0-9A-Fa-f]{6}$"))
    return (
        F.when(F.exists(bounds, lambda b: b.isNull()), "bad_bounds")
        .when(F.size(colors) < F.size(bounds) - 1, "too_few_colors")
        .when(bad, "bad_color")
        .otherwise("ok")
    )


def classify(value, bounds) -> Column:
    """Left-closed class number: -1 under the first bound, n-1 at or above the last
    of n bounds, NULL for a missing value.

    Literal bounds become a CASE, which stays in generated code; a bounds column is
    searched for each row.
    """
    value = _col(value)
    if isinstance(bounds, (list, tuple)):
        bounds = sorted(float(b) for b in bounds)
        index = F.when(value.isNull(), F.lit(None).cast("int"))
        for i, b in enumerate(bounds):
            index = index.when(value < F.lit(b), i - 1)
        return index.otherwise(len(bounds) - 1)
    below = F.size(F.filter(_col(bounds), lambda b: b <= value)) - 1
    return F.when(value.isNotNull(), below)


def class_color(index, n_bounds: int, colors) -> Column:
    """Colour of a class.  Spare colours are spread over the classes; below and above
    the bounds take the first and the last colour; no class is transparent."""
    index, regions, last = _col(index), n_bounds - 1, len(colors) - 1
    if len(colors) < regions:
        raise ValueError("fewer colors than classes")
    color = F.when(index.isNull(), TRANSPARENT).when(index < 0, colors[0])
    for i in range(regions):
        if len(colors) == regions:
            pick = i
        elif regions == 1:
            pick = last // 2
        else:
            pick = int(last / (regions - 1) * i)
        color = color.when(index == i, colors[pick])
    return color.otherwise(colors[-1])


def style_stops(style: str):
    return sorted(STYLES[style])


def _rgb(color: str) -> tuple[int, int, int]:
    return int(color[1:3], 16), int(color[3:5], 16), int(color[5:7], 16)


def color_ramp(value, style) -> Column:
    """Linear mix between the two stops around a value, as struct(color, opacity).

    The stops are few and known when the plan is made, so each segment is one branch
    of a CASE with literal ends: no join, no lookup, and generated code stays small.
    ``style`` is a name in ``STYLES`` or a list of stops.
    """
    stops = sorted(STYLES[style] if isinstance(style, str) else style)
    value = _col(value).cast("double")

    def packed(color):
        r, g, b = _rgb(color)
        return F.lit((r << 16) + (g << 8) + b).cast("bigint")

    first, last = stops[0], stops[-1]
    color = F.when(value < F.lit(float(first[0])), packed(first[1]))
    opacity = F.when(value < F.lit(float(first[0])), F.lit(float(first[3])))
    for (q0, c0, _, a0), (q1, c1, _, a1) in zip(stops, stops[1:]):
        share = (value - F.lit(float(q0))) / F.lit(float(q1) - float(q0))
        mixed = F.lit(0).cast("bigint")
        for low, high, place in zip(_rgb(c0), _rgb(c1), (1 << 16, 1 << 8, 1)):
            if low == high:
                level = F.lit(low).cast("bigint")
            else:
                level = F.floor(F.lit(float(low)) + F.lit(float(high - low)) * share + F.lit(0.5))
            mixed = mixed + level * F.lit(place)
        color = color.when(value < F.lit(float(q1)), mixed)
        if a0 != a1:
            ramp = F.lit(float(a0)) + F.lit(float(a1 - a0)) * share
            opacity = opacity.when(value < F.lit(float(q1)), ramp)
        elif a0 != last[3]:
            opacity = opacity.when(value < F.lit(float(q1)), F.lit(float(a0)))
    color, opacity = color.otherwise(packed(last[1])), opacity.otherwise(float(last[3]))
    text = F.concat(F.lit("#"), F.lpad(F.hex(color), 6, "0"))
    return F.struct(
        F.when(value.isNull(), TRANSPARENT).otherwise(text).alias("color"),
        F.when(value.isNull(), F.lit(0.0)).otherwise(opacity).alias("opacity"),
    )

"""Names of variables, outputs and granules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terracell.functions.geo import _col

# Where providers publish a day, and the date formats that fill it in.
GRANULE_TEMPLATES = {
    "chirps": (
        "https://data.chc.ucsb.edu/products/CHIRPS/v3.0/daily/final/IMERGlate-v07/%s/chirps-v3.0.%s.tif",
        ("yyyy", "yyyy.MM.dd"),
    ),
    "merge": (
        "https://ftp.cptec.inpe.br/modelos/tempo/MERGE/GPM/DAILY/%s/%s/MERGE_CPTEC_%s.grib2",
        ("yyyy", "MM", "yyyyMMdd"),
    ),
}
# Output names of vegetation sources.
VEGETATION_NAMES = {"sentinel2": "ndvi_s2", "modis": "ndvi_modis"}
# Accepted spellings of the axes.
LON_NAMES = ("longitude", "lon", "long")
LAT_NAMES = ("latitude", "lat")
TIME_NAMES = ("time", "valid_time", "datetime")


def granule_uri(source, date) -> Column:
    """Where a source publishes a day; NULL for a source without a template."""
    source, date = _col(source), _col(date)
    uri = F.lit(None).cast("string")
    for name, (template, formats) in GRANULE_TEMPLATES.items():
        text = F.format_string(template, *[F.date_format(date, f) for f in formats])
        uri = F.when(source == name, text).otherwise(uri)
    return uri


def granule_name(source, date) -> Column:
    """``<source>_<yyyyMMdd>.tif``"""
    return F.concat(_col(source), F.lit("_"), F.date_format(_col(date), "yyyyMMdd"), F.lit(".tif"))


def output_name(variable, statistic) -> Column:
    """Dataset name of a variable and daily statistic, from the words in them."""
    variable, statistic = _col(variable), _col(statistic)
    temperature = (
        F.when(statistic.contains("maximum"), "temp_max")
        .when(statistic.contains("minimum"), "temp_min")
        .otherwise("temp")
    )
    other = F.replace(F.concat_ws("_", variable, statistic), F.lit("_"), F.lit("-"))
    return (
        F.when(variable.contains("temperature"), temperature)
        .when(variable.contains("precipitation"), "precipitation")
        .otherwise(other)
    )


def vegetation_name(source) -> Column:
    source = _col(source)
    name = F.concat(F.lit("ndvi_"), source)
    for key, value in VEGETATION_NAMES.items():
        name = F.when(source == key, value).otherwise(name)
    return name


def resolve_variable(columns, variable: str, aliases=(), fuzzy: bool = True) -> str:
    """Column that holds a variable: the name, the name without underscores, an
    alias, then (``fuzzy``) any column that contains a part of the name."""
    names = dict.fromkeys([variable, variable.replace("_", ""), *aliases])
    place = {name: k for k, name in enumerate(names)}
    parts = {p for p in variable.split("_") if p} if fuzzy else set()

    def how_close(column: str) -> int | None:
        """Smaller is closer; a part of the name in it is the farthest match."""
        return place.get(column, len(place) if any(p in column for p in parts) else None)

    matches = [c for c in columns if how_close(c) is not None]
    if not matches:
        raise ValueError(f"no column for {variable!r} among {list(columns)}")
    return min(matches, key=how_close)


def time_attribute(columns) -> str:
    """Name of the day attribute an index of these columns is keyed by."""
    return "time" if "time" in columns else "ingestion"

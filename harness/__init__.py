"""Check queries: the library on climate tables derived from the driver tables, each
next to the SQL that must give the same rows."""

from harness.tables import ORACLES, REGISTRY
from harness import calendars, files, jobs, points, rasters, stored, vegetation  # noqa: F401  (they register their queries)

__all__ = ["ORACLES", "REGISTRY"]

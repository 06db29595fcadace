"""Arriving cells: append once, test against triggers.  Arriving files: days overdue.

Raster days arrive days late as a rule and are final when they do, so no watermark drops
rows: a late day is simply a new day.
"""

from terracell.streaming.gaps import gap_changes, overdue_days, track_gaps
from terracell.streaming.jobs import cell_stream, stream_append, stream_exceedances

__all__ = ["cell_stream", "gap_changes", "overdue_days", "stream_append", "stream_exceedances", "track_gaps"]

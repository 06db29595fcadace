"""Tables in and out: archive, daily rasters, granules, tiles, catalog, requests."""

"""DataFrame-to-DataFrame operators on the canonical tables."""

"""Named queries and ingest jobs: compositions of the operators."""

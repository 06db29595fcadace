"""Column functions: no joins, no shuffles, everything stays in generated code."""

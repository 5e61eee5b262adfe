"""Column expressions and the few functions Spark lacks."""

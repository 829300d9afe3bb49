"""Column expressions: time grid arithmetic, unknown-value handling, aggregates."""

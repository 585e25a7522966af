"""Column expressions: one row in, one value out, no shuffle."""

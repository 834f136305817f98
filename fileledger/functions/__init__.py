"""Column expressions: every one runs inside Spark's own code generation."""

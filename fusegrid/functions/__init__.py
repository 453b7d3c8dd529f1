"""Column expressions: geometry, boxes and vectors."""

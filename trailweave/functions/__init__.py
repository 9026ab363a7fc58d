"""Column expressions: lifecycle, paths, predicates, text and numbers."""

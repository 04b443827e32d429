"""Rules compiled to columns: predicates, decision tables, downgrades."""

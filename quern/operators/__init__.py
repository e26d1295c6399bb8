"""Relational operators: rules as joins, aggregates, fixpoints and loops."""

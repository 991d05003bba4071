"""Predicates and aggregates as Column expressions."""

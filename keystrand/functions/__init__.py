"""Registered predicates and aggregates, and ranking."""

"""Predicates: their form, their row filter, and their three-valued evaluation on statistics and pages."""

"""Compiling predicates, zone maps and the pruner."""

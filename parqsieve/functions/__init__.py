"""Helpers of single values: prefix successors and bloom hashes."""

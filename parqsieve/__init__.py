"""Metadata-driven data skipping on Parquet for PySpark."""

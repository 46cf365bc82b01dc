"""Reading Parquet footers, indexes and bloom filters, and writing layouts."""

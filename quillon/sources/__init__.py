"""Files of records: JSON lines (plain or gzip), CSV and Parquet in, append out. Schemas are given, never inferred."""

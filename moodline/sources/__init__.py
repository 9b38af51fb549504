"""Sources and sinks: the given parquet tables, pandas-compatible CSV, the
model store."""

"""The catalog, table storage, and Parquet sources and sinks."""

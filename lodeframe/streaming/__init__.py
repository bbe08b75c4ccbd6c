"""Event-time aggregates over streams of Parquet files: an extension beyond the batch engine."""

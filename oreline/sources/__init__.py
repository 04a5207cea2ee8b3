"""Reading raw batches and keeping tables as snapshot-partitioned parquet."""

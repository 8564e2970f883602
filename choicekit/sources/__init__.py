"""Sources and sinks: driver tables, CSV/TSV, stage Parquet, JSON documents."""

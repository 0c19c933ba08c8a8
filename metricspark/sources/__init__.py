"""Sources and sinks: parquet tables, CSV scan, JSON records, previews."""

"""Sources and sinks: price panels from fact tables, parquet/CSV result tables."""

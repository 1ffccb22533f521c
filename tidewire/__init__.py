"""Event-intelligence analytics on PySpark: text posts in, deduplicated, classified, clustered, scored and routed events out."""

"""Log analytics on Spark: ingest, filter, page, aggregate and expire structured logs."""

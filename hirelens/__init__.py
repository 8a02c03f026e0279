"""Job-posting analytics on Spark: ingest, reconcile, resolve, extract, embed, match."""

"""Log analytics on Spark: parsing, search, dashboards, rollups and incremental ingestion of web-server logs."""

"""folia: document analytics on PySpark (ingestion, retrieval, snapshot diff, metering)."""

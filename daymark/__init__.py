"""daymark: daily market time-series analytics expressed as Spark DataFrame jobs."""

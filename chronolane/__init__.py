"""Point-in-time event and market analytics expressed as Spark DataFrame operations."""

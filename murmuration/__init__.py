"""Community and topic analytics on message streams, as PySpark DataFrame jobs."""

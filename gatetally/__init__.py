"""Reports on API gateway request logs with PySpark, in batch and as a stream."""

"""Request-tracking analytics on Spark."""

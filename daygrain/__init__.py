"""Life-log trajectory analytics on Spark."""

"""A versioned, index-aligned feature lake on Spark."""

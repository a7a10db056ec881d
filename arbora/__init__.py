"""Object-style analytics on Spark."""

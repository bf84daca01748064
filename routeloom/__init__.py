"""Model-routing analytics on Spark."""

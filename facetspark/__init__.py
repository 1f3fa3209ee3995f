"""Multi-view retrieval analytics on Spark."""

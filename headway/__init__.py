"""Transit feed quality jobs on Spark."""

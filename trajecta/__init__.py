"""Trajectory and training-data analytics as PySpark DataFrame, SQL and Structured Streaming operators."""

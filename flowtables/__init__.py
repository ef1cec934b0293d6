"""Keyed stream and table analytics as plain PySpark DataFrame code."""

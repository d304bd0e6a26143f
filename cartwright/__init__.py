"""Commerce event analytics as PySpark DataFrame functions."""

"""Document-corpus and path analytics as plain PySpark."""

"""Document retrieval with checked grounding, as PySpark jobs."""

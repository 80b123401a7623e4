"""Data work of document-grounded retrieval as PySpark jobs."""

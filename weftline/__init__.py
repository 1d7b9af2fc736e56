"""Weftline: document ingestion, hybrid retrieval and evaluation as Spark DataFrame plans."""

"""Document corpora, entity graphs and retrieval as plain PySpark jobs."""

__version__ = "0.1.0"

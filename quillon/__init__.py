"""quillon: a code-search and corpus-processing engine written for PySpark."""

__version__ = "0.1.0"

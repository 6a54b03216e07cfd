"""parity: compare tables, files, queries and catalogs on Spark."""

__version__ = "0.1.0"

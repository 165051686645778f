"""tidemark: analytics over mobile and web app event logs, as Spark DataFrame operators."""

__version__ = "0.1.0"

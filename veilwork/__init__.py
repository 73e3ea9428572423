"""veilwork: personal-data discovery and redaction over Spark tables and streams."""

__version__ = "0.1.0"

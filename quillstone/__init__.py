"""Documents, their structure and their history as Spark tables."""

__version__ = "0.2.0"

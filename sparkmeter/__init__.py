"""Token-usage analytics for conversation and coding-agent logs, as Spark jobs."""

__version__ = "0.1.0"

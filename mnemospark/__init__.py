"""Conversation-memory analytics on Spark: ingest, search, curation, evaluation and replicated-log sync as DataFrame plans."""

__version__ = "0.1.0"

"""Streaming ingestion, an extension."""

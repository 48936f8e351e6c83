"""Ingestion operators under Structured Streaming."""

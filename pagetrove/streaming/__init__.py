"""Structured Streaming forms of ingest and sighting de-duplication."""

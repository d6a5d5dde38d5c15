"""Streaming ingestion and windows."""

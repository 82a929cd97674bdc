"""Structured Streaming: upload intake."""

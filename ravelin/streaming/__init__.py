"""Structured Streaming variants of ingest and answer-stream assembly."""

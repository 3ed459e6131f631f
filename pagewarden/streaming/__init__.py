"""Audits of pages as they arrive, with Structured Streaming."""

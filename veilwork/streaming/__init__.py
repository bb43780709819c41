"""Masks and reports over Structured Streaming."""

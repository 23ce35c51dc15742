"""Continuous parsing with Structured Streaming."""

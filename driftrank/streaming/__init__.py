"""Structured Streaming around the engine."""

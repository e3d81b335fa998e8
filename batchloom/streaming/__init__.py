"""Structured Streaming sink, liveness and idle rotation."""

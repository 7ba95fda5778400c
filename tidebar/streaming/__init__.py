"""Streaming of the bar engine."""

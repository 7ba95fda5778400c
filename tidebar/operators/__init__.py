"""Operators of the bar engine."""

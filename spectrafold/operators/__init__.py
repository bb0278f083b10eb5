"""Spectrafold operators."""

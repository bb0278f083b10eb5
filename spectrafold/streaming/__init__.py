"""Spectrafold streaming."""

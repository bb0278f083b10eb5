"""Spectrafold sources."""

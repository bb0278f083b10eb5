"""Spectrafold functions."""

"""Streaming of the diff engine."""

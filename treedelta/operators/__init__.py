"""Operators of the diff engine."""

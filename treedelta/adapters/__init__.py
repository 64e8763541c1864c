"""Parsers from text to trees."""

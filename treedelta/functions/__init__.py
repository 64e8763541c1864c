"""Functions of the diff engine."""

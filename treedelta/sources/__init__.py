"""Sources of the diff engine."""

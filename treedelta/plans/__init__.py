"""Plans of the diff engine."""

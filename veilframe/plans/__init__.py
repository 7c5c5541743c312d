"""Plans of the privacy engine."""

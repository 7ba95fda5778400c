"""Plans of the bar engine."""

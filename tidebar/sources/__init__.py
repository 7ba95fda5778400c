"""Sources of the bar engine."""

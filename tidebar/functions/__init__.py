"""Functions of the bar engine."""

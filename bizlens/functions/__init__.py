"""See the package docstring of bizlens."""

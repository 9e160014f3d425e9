"""See the package docstring of parchmill."""

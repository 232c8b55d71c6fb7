"""See the package docstring in spanloom/__init__.py."""

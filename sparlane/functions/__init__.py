"""Part of sparlane; see the package docstring."""

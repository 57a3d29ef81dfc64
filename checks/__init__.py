"""Checks of the library against SQL on the driver tables."""

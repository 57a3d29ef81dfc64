"""The panels, composed from the operators."""

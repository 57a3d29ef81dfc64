"""Input tables and materialised stages."""

"""Operators for preparing training data (independent of the rest of the library)."""

"""Operators for language-model training data. Nothing outside of this package imports it."""

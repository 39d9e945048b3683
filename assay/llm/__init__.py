"""Operators for preparing text collections for language-model training."""

"""Operators for training corpora. Nothing else in the package imports this part."""

"""Operators for training data: one module each, with its check query beside it."""

"""Scalar functions: identity, text, path and similarity expressions."""

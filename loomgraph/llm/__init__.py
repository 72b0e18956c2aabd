"""Operators of a training-data pipeline: ten of them, each in a module of its own."""

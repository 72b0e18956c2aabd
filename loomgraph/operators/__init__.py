"""Relational and iterative graph operators over DataFrames."""

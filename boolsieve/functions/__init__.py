"""Scalar functions and column expressions."""

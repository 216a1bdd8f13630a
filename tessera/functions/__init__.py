"""Scalar functions and types."""

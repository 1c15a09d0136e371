"""Scalar functions and byte layouts."""

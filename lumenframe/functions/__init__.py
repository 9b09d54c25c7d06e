"""Scalar and array kernels, and their registration as SQL functions."""

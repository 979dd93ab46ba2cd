"""Numeric kernels on numpy arrays, called from Arrow functions."""

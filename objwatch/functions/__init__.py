"""Scalar functions with the monitor's semantics."""

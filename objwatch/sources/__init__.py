"""Traces in, verdicts out."""

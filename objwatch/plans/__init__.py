"""Distributed orderings, and the registered queries."""

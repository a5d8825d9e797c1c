"""Monitoring of object streams on Spark: sparse signals, per-object state, rules, quantified rules, verdicts."""

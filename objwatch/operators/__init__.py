"""Objects, temporal access, activation, rules, quantifiers and verdicts."""

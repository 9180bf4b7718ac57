"""Driver-side planning: modes, predicates, read plans."""

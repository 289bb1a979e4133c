"""Column-level building blocks: ordering keys, predicates and text functions."""

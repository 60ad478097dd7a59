"""Relational operators: budgets, mixing, batching, metrics, masks, skew handling."""

"""Plans on metadata: when to flush, and what to compact."""

"""Composite queries: measurements and correlations."""

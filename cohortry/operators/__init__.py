"""Relational operators and the analytic patterns built from them."""

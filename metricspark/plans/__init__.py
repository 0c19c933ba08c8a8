"""Composed plans: skew-safe ordering, the preprocessing chain, registered queries."""

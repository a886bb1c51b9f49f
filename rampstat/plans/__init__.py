"""Composed query plans: the driver queries and their SQL oracles."""

"""Relational and order-dependent operators of the engine."""

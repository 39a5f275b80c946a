"""Operators of the relation-verification library."""

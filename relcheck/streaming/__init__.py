"""Streaming of the relation-verification library."""

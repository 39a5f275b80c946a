"""Functions of the relation-verification library."""

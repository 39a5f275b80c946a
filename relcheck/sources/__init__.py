"""Sources of the relation-verification library."""

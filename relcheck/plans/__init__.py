"""Plans of the relation-verification library."""

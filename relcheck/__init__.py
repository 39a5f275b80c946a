"""Relation-verification analytics on Spark: parsers, joins, metrics, statistics and samplers over DataFrames."""

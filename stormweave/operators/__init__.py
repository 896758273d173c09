"""DataFrame operators: validation, correlation, evidence, joins, filters and merges."""

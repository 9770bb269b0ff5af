"""DataFrame operators: generators, filters, joins, aggregates and report analytics."""

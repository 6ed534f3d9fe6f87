"""DataFrame operators: ordering, joins, sampling, vectors, metrics, images."""

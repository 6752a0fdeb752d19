"""DataFrame operators: numbering, joins, selection, gates, merge, history, publication."""

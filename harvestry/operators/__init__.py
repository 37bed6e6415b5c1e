"""DataFrame operators: rows, joins, paging, diagnostics, discovery and repair."""

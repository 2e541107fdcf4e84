"""Reusable DataFrame operators: rows, joins, aggregates, windows, reshaping, ranking, sampling."""

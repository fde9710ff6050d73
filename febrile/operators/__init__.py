"""Relational operators: filters, upserts, joins, aggregates, top-k, stock,
place resolution, model preparation and evaluation."""

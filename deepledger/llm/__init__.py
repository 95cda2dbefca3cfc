"""Operators for preparing training text: search, joins, filters, formats and packing."""

"""Operators for preparing training text; nothing else in cytoframe imports them."""

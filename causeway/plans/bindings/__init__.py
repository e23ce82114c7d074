"""Operators applied to relations derived from the driver tables, each with its SQL."""

"""Readers of index lines and source trees."""

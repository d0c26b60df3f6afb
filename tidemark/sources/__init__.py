"""Readers of feeds, as plans over payload columns, and writers."""

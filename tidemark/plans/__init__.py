"""Derived relations of the queries: fund series, trades and holdings over the order tables."""

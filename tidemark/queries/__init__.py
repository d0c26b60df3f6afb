"""Registered queries of the market-data operators with their SQL twins."""

from tidemark.queries import holdings, indicators, metrics, more, portfolio, quality, registry, screener, series, sources, streams

_PAGES = (series, metrics, portfolio, holdings, screener, registry, quality, indicators, sources, streams, more)
QUERIES = {name: query for page in _PAGES for name, query in page.BOOK.queries.items()}
ORACLES = {name: sql for page in _PAGES for name, sql in page.BOOK.oracles.items()}

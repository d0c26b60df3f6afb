"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from tidemark.llm import chat, decontam, divergence, licenses, lines, neardup, phrases, pieces, quality, rules, sharding, topk, toxicity

_MODULES = (quality, licenses, pieces, decontam, sharding, chat, lines, neardup, toxicity, topk, divergence, phrases, rules)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

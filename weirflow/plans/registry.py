"""All queries of the core, with their SQL."""

from __future__ import annotations

from . import analyses, code, fixture, general, graphs, joining, policies, texts

FLAGSHIP = "gr10_backward_reach"
_BOOKS = (graphs.book, policies.book, joining.book, texts.book, analyses.book, code.book, fixture.book)
QUERIES = {**general.QUERIES, **{k: v for b in _BOOKS for k, v in b.queries.items()}}
ORACLE = {**general.ORACLE, **{k: v for b in _BOOKS for k, v in b.sql.items()}}

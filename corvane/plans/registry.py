"""All queries over the given tables, with the SQL that each must equal."""

from __future__ import annotations

from corvane.plans import answers, base, catalog, corpus, entities, evaluation, ledger, matching, pages, retrieval, streams, structure, supporting, textual  # noqa: F401  each registers its queries

QUERIES = base.QUERIES
ORACLES = base.ORACLES
FLAGSHIP = "hybrid_search"

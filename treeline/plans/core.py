"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from treeline.plans import evals, records_and_trees, roundtrips, schemes, texts, trees

FLAGSHIP = "search_default"
QUERIES = records_and_trees.QUERIES | trees.QUERIES | schemes.QUERIES | texts.QUERIES | evals.QUERIES | roundtrips.QUERIES
SQL = records_and_trees.SQL | trees.SQL | schemes.SQL | texts.SQL | evals.SQL | roundtrips.SQL

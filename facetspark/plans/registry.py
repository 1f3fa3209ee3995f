"""Every registered query with its oracle SQL, collected from the query modules."""

from __future__ import annotations

from facetspark.plans import adapters, answers, channels, details, evaluation, facts, helpers, relational, reports, retrieval, studies, texts

FLAGSHIP = "k6_bm25_top10"
QUERIES: dict = {}
ORACLES: dict = {}
for module in (retrieval, texts, relational, evaluation, details, channels, adapters, reports, helpers, studies, answers, facts):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)

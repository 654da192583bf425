"""All queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from . import company, coverage, feeds, filings, fiscal, graphs, helpers, ledger, live, network, prices, registers, relational, scores

MODULES = (prices, company, coverage, registers, filings, live, relational, fiscal, graphs, feeds, scores, ledger, network, helpers)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}

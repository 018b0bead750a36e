"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import infilling, jaccard, licenses, lines, merkle, mixing, neighbours, packing, pii, pipeline, resampling, substrings, suffixes, toxicity

_MODULES = (infilling, jaccard, licenses, lines, merkle, mixing, neighbours, packing, pii, resampling, substrings, suffixes, toxicity)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
QUERIES["pipeline"] = pipeline.run
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL

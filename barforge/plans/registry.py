"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from . import candidates, evaluation, extra, labelling, modelling, technical

_PARTS = (technical, labelling, evaluation, modelling, candidates, extra)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}

"""A corpus of documents from raw rows to packed sequences: the stages of ``vozlens.llm.pipeline`` by name."""

from __future__ import annotations

from vozlens.llm.pipeline import STAGES, run

#: No SQL for a discriminant's scores or for packing; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]

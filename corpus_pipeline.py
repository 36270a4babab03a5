"""The training-corpus pipeline; its stages are in skyfold/llm/pipeline.py."""

from __future__ import annotations

from skyfold.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""The corpus pipeline; its stages are in strophe.llm.pipeline."""

from strophe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

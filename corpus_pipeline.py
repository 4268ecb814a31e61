"""The pipeline of five stages; see tidemark.llm.pipeline."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

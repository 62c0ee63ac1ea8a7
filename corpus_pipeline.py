"""The pipeline of the text operators at the top of the repository: see :mod:`daymark.llm.pipeline`."""

from daymark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

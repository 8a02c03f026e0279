"""From raw documents to packed training sequences, in five stages: see `hirelens.llm.pipeline`."""

from hirelens.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

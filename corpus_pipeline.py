"""The five stages from documents to token files; they live with the operators in ``orrery.llm``."""

from orrery.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

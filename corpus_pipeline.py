"""From raw documents to packed training sequences, in five stages: see ``lodestone/llm/stages.py``."""

from lodestone.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

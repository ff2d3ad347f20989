"""A training corpus from raw documents; the stages are in the subpackage of their operators."""

from loamline.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""The corpus pipeline: documents through toxicity, exact and near dedup, decontamination and mixing.

Its stages are in routeloom.llm.pipeline; this module names them where they are looked for.
"""

from routeloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

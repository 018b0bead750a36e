"""The corpus pipeline, from documents to packed sequences: see kinfolio/llm/pipeline.py.

STAGES lists (name, function); run(spark, sf_dir) applies them to ``documents``.
"""

from kinfolio.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

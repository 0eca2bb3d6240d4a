"""The corpus pipeline of the training-data operators: STAGES, ORACLE_SQL and run(spark, sf_dir); see photonlake/llm/pipeline.py."""

from photonlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

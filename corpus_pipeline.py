"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes what a stage
returns to the shared folder and reads it again for the next.
"""

from tripstream.llm.stages import STAGES, run

#: The learned classifier has no SQL.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]

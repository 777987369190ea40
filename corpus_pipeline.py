"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, piece encoding.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet
and read again as the next one's docs. ``run`` applies all of them to ``documents``.
"""

from motorlake.llm.stages import STAGES, run

#: SimHash groups, edit distances and piece ids are not expressible in SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""Corpus pipeline: quality classifier, near-dedup, decontamination, mixing and sharding, one after the other.

The stages are in inkwell.llm.pipeline. Each takes (spark, docs, sf_dir); the result is written as Parquet and read
again as the next stage's docs.
"""

from inkwell.llm.pipeline import STAGES, materialize, run

#: No SQL twin: classifier, fingerprints and windows are not expressible there. Tests hold each stage to a brute-force version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "materialize", "run"]

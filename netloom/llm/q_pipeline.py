"""The whole corpus pipeline as one query."""

import corpus_pipeline
from netloom.llm.registry import query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

"""Imports every query module of the subpackage; the registries fill as a side effect."""

from netloom.llm import q_bpe, q_lines, q_mixing, q_neardup, q_passages, q_pii, q_pipeline, q_quality, q_secrets, q_sentence_pieces, q_topk, q_toxicity, q_vector_codes, q_whitening  # noqa: F401
from netloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quarry.llm import bpe, embedding_dedup, jaccard_join, licenses, mixing, quality, substring_dedup, token_counts, topk_search, toxicity

MODULES = (quality, licenses, toxicity, bpe, topk_search, embedding_dedup, jaccard_join, substring_dedup, token_counts, mixing)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}

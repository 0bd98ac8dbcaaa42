"""Queries and SQL of the training-data operators."""

from . import chat_format, decontaminate, embed_dedup, jaccard_join, line_dedup, mixing, quality, token_counts, tokens_out, warc

_MODULES = (line_dedup, token_counts, quality, chat_format, tokens_out, mixing, decontaminate, embed_dedup, jaccard_join, warc)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}

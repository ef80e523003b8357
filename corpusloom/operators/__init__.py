"""Operators on corpora: filters, dedup, contamination, mixing, packing, chat, statistics, validation, tokenizers."""

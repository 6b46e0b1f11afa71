"""Training-data operators (mixing, tokenizing, dedup, quality, search, output)."""

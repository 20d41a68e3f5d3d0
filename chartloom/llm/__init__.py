"""Training-data operators: quality, dedup, privacy, mixing, tokens, shards and URL rules."""

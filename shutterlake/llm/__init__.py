"""Training-data operators: media columns, tokens, dedup, scans, mixing, quality."""

"""Training-data operators: sanitising, tokenising, near-duplicates, mixing, quality."""

"""Training-data operators: quality, mixing, secrets, tokenizers, near-duplicates, privacy."""

"""Training-data operators: dedup, sharding, mixing, WARC, tokens, secrets, toxicity, near-dedup, fingerprints, packing."""

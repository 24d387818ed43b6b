"""Training-data operators: toxicity, sharding, preference formatting, fingerprints, search, packing."""

"""Training-data operators: fingerprints, deduplication, filters, mixing, packing, tokens, shards."""

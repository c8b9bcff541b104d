"""Training-data operators: deduplication, packing, sharding, tokenising, scoring and search."""

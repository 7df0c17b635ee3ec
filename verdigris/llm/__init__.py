"""Training-data operators: counting, filtering, deduplication, mixing, sharding, packing, search."""

"""Training-data operators: filtering, deduplication, sharding, packing, scoring and formatting."""

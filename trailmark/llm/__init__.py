"""Training-data operators: tokenising, filtering, deduplication, scoring, mixing and sharding."""

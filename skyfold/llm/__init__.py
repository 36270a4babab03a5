"""Training-data operators: deduplication, tokens, packing, sharding, extraction, media, scoring, archives and search."""

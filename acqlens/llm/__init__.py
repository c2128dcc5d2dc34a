"""Training-data operators: packing, secrets, deduplication, quality, language, mixing."""

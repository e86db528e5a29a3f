"""Training-data operators: deduplication, packing, search, language models."""

"""Training-data operators: dedup, packing, quality, extraction, token output."""

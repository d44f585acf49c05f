"""Training-data operators: deduplication, decontamination, quality, packing and search."""

"""Training-data operators: filters, deduplication, decontamination, extraction and packing."""

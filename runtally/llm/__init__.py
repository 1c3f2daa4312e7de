"""Training-data operators: fingerprints, filters, de-duplication, archives, tokenizers and packing."""

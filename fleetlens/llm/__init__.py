"""Training-data operators: placement, deduplication, scoring, decontamination, packing, counting."""

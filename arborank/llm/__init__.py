"""Training-data operators: dedup, filtering, decontamination, archives and packing."""

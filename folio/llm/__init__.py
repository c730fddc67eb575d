"""Training-data operators: token counts, dedup, scoring, archives, mixing, cleaning."""
